"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two words counts the subsequences of 3 and 4 characters (with word ends) that they share, each occurrence
weighted by ``decay`` to the number of characters that it leaps over, up to ``gap`` in all. So a word with an inserted
or exchanged character keeps much of its likeness to the word as it was; dots and dashes inside a word are dropped
before, and letters that stand alone one after another are read as one word too.

A sentence counts as much as its worst word, and a document as its worst sentence. What is labelled is the document;
training finds the word that makes a toxic one toxic by rounds, as multiple-instance learning does: fit, take the
highest word of every toxic document as its witness, fit again. Positive examples are the witnesses, and copies of them
with a character inserted; negative ones are words of clean documents, the highest among them.

Words are seen through the kernel's values at ``landmarks`` words of both kinds (Nyström), and a linear machine with
squared hinge loss is fitted there by Newton's method. As kernel values are sums over subsequences, the machine folds into one
weight for each subsequence of the landmarks, without loss, so that a new word costs a lookup for each of its
subsequences.

Training takes a bounded sample: ``per_class`` documents of each label by the order of a hash, and of each ``words`` distinct words
at the most. One half is fitted alone first, and the other half's scores give the sigmoid that turns the machine's
values into probabilities (Platt), as if ``share`` of the documents were toxic: more than are, so that few are missed.

Defined cases: a null or empty text, or one without a letter or digit, is scored as a text without an insult (the value 0
if there is nothing to learn from); a word of more than 32 characters is read through overlapping windows; a null doc_id
counts as not held out; repeated rows are scored each, and a doc_id's label is the highest of its labels; null labels are ignored; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import batched, rows_of
from quire.llm.storage import materialize, picked

#: Characters of a window, and by how many windows overlap; words whose scores a task remembers; words scored at once.
WINDOW, OVERLAP, MEMO, TOGETHER = 32, 8, 200_000, 4096

SPACED = re.compile(r"(?<!\S)(?:[^\s.!?][^\S\n]+){2,}[^\s.!?](?!\S)")
SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?=[^\s.!?]))+[.!?\n]*|[.!?\n]+")


@dataclass(frozen=True)
class Settings:
    per_class: int = 1200
    words: int = 2000
    sizes: tuple[int, ...] = (3, 4)
    gap: int = 2
    decay: float = 0.5
    landmarks: int = 240
    negatives: int = 6000
    rounds: int = 3
    copies: int = 2
    cost: float = 60.0
    share: float = 0.2
    seed: int = 5


def units(token: str) -> list[str]:
    """What a token is read as: its letters and digits between word ends, in windows if there are many."""
    plain = token.lower()
    if not plain.isalnum() or not (plain.isascii() or unicodedata.is_normalized("NFKC", plain)):
        plain = "".join(c for c in unicodedata.normalize("NFKC", plain).lower() if c.isalnum())
        if not plain:
            return []
    whole = f"^{plain}$"
    return [whole] if len(whole) <= WINDOW else [whole[i : i + WINDOW] for i in range(0, len(whole) - OVERLAP, WINDOW - OVERLAP)]


def tokens(text: str) -> set[str]:
    """The different tokens of a text, in lower case and without common punctuation, and its runs of characters that stand alone."""
    plain = text.lower()
    for c in ".,;:!?|":
        plain = plain.replace(c, "")
    found = set(plain.split())
    if " " in text or "\t" in text:
        found.update("".join(m.group().split()) for m in SPACED.finditer(text))
    return found


def mixed(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = h ^ codes
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def subsequences(words: list[str], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``words``, hashes, weights) of words of one length: a row of 64-bit hashes a word, a weight a column."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    for n, own in by_size.items():
        joined = "".join([words[i] for i in own]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, np.uint32).reshape(len(own), n).astype(np.uint64)
        hashes, weights = [], []

        def extend(h: np.ndarray, size: int, last: int) -> None:
            """Subsequences of ``size`` characters, the last one ``last`` places after the first."""
            if size in settings.sizes:
                hashes.append(h)
                weights.append(np.full(h.shape[1], settings.decay ** (last + 1 - size), np.float32))
            if size < max(settings.sizes):
                for place in range(last + 1, min(n, size + settings.gap + 1)):
                    extend(mixed(h[:, : n - place], codes[:, place:]), size + 1, place)

        extend(mixed(np.uint64(7), codes), 1, 0)
        if hashes:
            yield np.array(own), np.concatenate(hashes, axis=1), np.concatenate(weights)


class Table:
    """Subsequences with a row of values each; looks up many at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values  # keys ascend
        head = (keys >> np.uint64(44)).astype(np.int64)
        self.first = np.full(1 << 20, -1, np.int32)  # of the keys with these 20 leading bits
        self.first[head[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.most = int(np.bincount(head).max()) if len(keys) else 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, key) of the hashes that are keys."""
        at = self.first[hashes >> np.uint64(44)]
        place = np.flatnonzero(at.ravel() >= 0)
        at, h = at.ravel()[place].astype(np.int64), hashes.ravel()[place]
        key = np.full(len(at), -1)
        for step in range(self.most):
            near = np.minimum(at + step, len(self.keys) - 1)
            key = np.where(self.keys[near] == h, near, key)
        hit = key >= 0
        place = place[hit]
        return place // hashes.shape[1], place % hashes.shape[1], key[hit]

    def sums(self, words: list[str], settings: Settings) -> np.ndarray:
        """For each word the weighted sum of the values of its subsequences."""
        out = np.zeros((len(words), *self.values.shape[1:]), np.float32)
        if not len(self.keys):
            return out
        for own, hashes, weights in subsequences(words, settings):
            row, column, at = self.find(hashes)
            if self.values.ndim == 1:
                out[own] = np.bincount(row, self.values[at] * weights[column], len(own))
                continue
            for low in range(0, len(row), 100_000):
                part = slice(low, low + 100_000)
                starts = np.flatnonzero(np.diff(row[part], prepend=-1))
                out[own[row[part][starts]]] += np.add.reduceat(self.values[at[part]] * weights[column[part], None], starts, axis=0)
        return out


def landmark_table(marks: list[str], settings: Settings) -> Table:
    keys, marked, weights = [], [], []
    for own, hashes, weight in subsequences(marks, settings):
        keys.append(hashes.reshape(-1))
        marked.append(np.repeat(own, hashes.shape[1]))
        weights.append(np.tile(weight, len(own)))
    if not keys:
        return Table(np.zeros(0, np.uint64), np.zeros((0, len(marks)), np.float32))
    found, code = np.unique(np.concatenate(keys), return_inverse=True)
    values = np.zeros((len(found), len(marks)), np.float32)
    np.add.at(values, (code, np.concatenate(marked)), np.concatenate(weights))
    return Table(found, values)


def newton(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """The linear machine (last entry: bias) of least squared hinge loss, each example weighted, and half the squared norm."""
    x = np.hstack([z, np.ones((len(z), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    loss = lambda w: 0.5 * w @ ridge @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(steps):
        open_ = y * (x @ w) < 1
        a, t, c = x[open_], y[open_], weight[open_][:, None]
        step = np.linalg.solve(ridge + 2 * a.T @ (a * c), -(ridge @ w + 2 * (a * c).T @ (a @ w - t)))
        now, size = loss(w), 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if now - loss(w) < 1e-6 * now:
            break
    return w


@dataclass
class Machine:
    table: Table
    bias: float
    settings: Settings = field(default_factory=Settings)

    def values(self, words: list[str]) -> np.ndarray:
        parts = [self.table.sums(words[i : i + TOGETHER], self.settings) for i in range(0, len(words), TOGETHER)]
        return np.concatenate(parts) + self.bias if parts else np.zeros(0)


def fit_machine(positive: dict[str, float], negative: list[str], settings: Settings) -> Machine:
    """Nyström features at landmarks of both kinds, and the machine over them, folded into one weight a subsequence.

    ``positive`` has a weight for each word. Of the positive words the heaviest are landmarks, of the negative some."""
    rng = np.random.default_rng(settings.seed)
    half = settings.landmarks // 2
    marks = sorted(positive, key=lambda w: (-positive[w], w))[:half] + [negative[i] for i in sorted(rng.choice(len(negative), min(half, len(negative)), replace=False))]
    marks = list(dict.fromkeys(marks))
    table = landmark_table(marks, settings)
    spectrum, axes = np.linalg.eigh(table.sums(marks, settings).astype(np.float64))
    used = spectrum > 1e-6 * spectrum[-1]
    whiten = axes[:, used] / np.sqrt(spectrum[used])
    words = [*positive, *negative]
    kernel = np.concatenate([table.sums(words[i : i + TOGETHER], settings) for i in range(0, len(words), TOGETHER)])
    weight = np.array([*positive.values()])
    weight = np.concatenate([settings.cost * weight / weight.sum(), np.full(len(negative), settings.cost / len(negative))])
    w = newton(kernel @ whiten, np.repeat([1.0, -1.0], [len(positive), len(negative)]), weight)
    return Machine(Table(table.keys, (table.values @ (whiten @ w[:-1])).astype(np.float32)), float(w[-1]), settings)


def first_values(docs: list[tuple[int, list[str]]]) -> dict[str, float]:
    """For each word of toxic documents, how much its best gram of four characters speaks for toxic documents."""
    counts: dict[str, list[int]] = {}
    totals = [0, 0]
    grams_of = lambda w: {w[i : i + 4] for i in range(max(1, len(w) - 3))}
    for label, words in docs:
        totals[label] += 1
        for g in set().union(*map(grams_of, words)):
            counts.setdefault(g, [0, 0])[label] += 1
    speaks = {g: b * np.log(b * totals[0] / (totals[1] * (a + 0.5))) for g, (a, b) in counts.items() if b}
    return {w: max(speaks[g] for g in grams_of(w)) for w in {w for label, words in docs if label for w in words}}


def witnesses(docs: list[tuple[int, list[str]]], value: dict[str, float], clean: set[str]) -> dict[str, float]:
    """Of each toxic document the words of the highest value, and those of at least half of it; words of clean documents only if it
    has no others. A word weighs as the root of the number of documents that it was found in."""
    found: dict[str, int] = {}
    for label, words in docs:
        if label:
            own = [w for w in words if w not in clean] or words
            least = max(value[w] for w in own)
            for w in own:
                if value[w] >= max(least / 2, min(least, 0)):
                    found[w] = found.get(w, 0) + 1
    return {w: n**0.5 for w, n in found.items()}


def with_insertions(words: dict[str, float], rng: np.random.Generator, copies: int) -> dict[str, float]:
    """The words, and for each some copies with a character inserted: one of the word's own, or a letter or digit."""
    out = dict(words)
    for w, weight in words.items():
        pool = w[1:-1] + "abcdefghijklmnopqrstuvwxyz0123456789"
        for _ in range(copies):
            at = int(rng.integers(2, max(3, len(w) - 1)))
            out.setdefault(w[:at] + pool[int(rng.integers(len(pool)))] + w[at:], weight / 2)
    return out


def fit_rounds(docs: list[tuple[int, list[str]]], settings: Settings) -> Machine:
    rng = np.random.default_rng(settings.seed)
    own = {w for label, words in docs if not label for w in words}
    clean = sorted(own) or ["^$"]
    toxic = sorted({w for label, words in docs if label for w in words})
    shown = [clean[i] for i in sorted(rng.choice(len(clean), min(settings.negatives, len(clean)), replace=False))]
    value = first_values(docs)
    for left in reversed(range(settings.rounds)):
        machine = fit_machine(with_insertions(witnesses(docs, value, own), rng, settings.copies), shown, settings)
        if not left:
            return machine
        value = dict(zip(toxic, machine.values(toxic).tolist()))
        hard = np.argsort(-machine.values(clean), kind="stable")[: settings.negatives // 3]
        shown = sorted({*shown, *(clean[i] for i in hard)})


@dataclass
class Model:
    machine: Machine | None
    slope: float = 0.0
    shift: float = 0.0
    lowest: float = 0.0  # the value of a document without words

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500)))


def platt(value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid: by Newton's method, with targets kept off 0 and 1, and the middle moved to the best cut."""
    high, low = (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2)
    target = np.where(label > 0, high, low)
    x, w = np.stack([value, np.ones(len(value))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-6 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    slope = float(max(w[0], 1e-3))
    return slope, -slope * best_cut(value, label, weight)


def best_cut(value: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The value that parts the labels with the least weight on the wrong side, in the middle of the widest such gap."""
    order = np.argsort(value)
    value, signed = value[order], np.where(label > 0, weight, -weight)[order]
    wrong = np.concatenate([[0.0], np.cumsum(signed)])  # of cuts below each value, and above all, less that of the first
    edges = np.concatenate([[value[0] - 1], value, [value[-1] + 1]])
    gaps = np.where(wrong <= wrong.min() + 1e-9, np.diff(edges), -1.0)
    k = int(gaps.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def fit(docs: list[tuple[int, list[str]]], settings: Settings = Settings()) -> Model:
    """A model of (label, different words) of documents."""
    docs = [(label, words) for label, words in docs if words]
    if {label for label, _ in docs} != {0, 1}:
        return Model(None, 0.0, -20.0 if not any(label for label, _ in docs) else 20.0)
    halves = [docs[0::2], docs[1::2]]
    if any({label for label, _ in h} != {0, 1} for h in halves):
        halves = [docs, docs]
    trial = fit_rounds(halves[0], settings)
    value = np.array([trial.values(words).max() for _, words in halves[1]])
    label = np.array([label for label, _ in halves[1]], float)
    weight = np.where(label > 0, settings.share / max(1.0, label.sum()), (1 - settings.share) / max(1.0, (1 - label).sum())) * len(label)
    slope, shift = platt(value, label, weight)
    machine = fit_rounds(docs, settings)
    return Model(machine, slope, shift, float(min(value.min(), machine.bias)))


class Scorer:
    """Scores texts; remembers the values of a bounded number of tokens."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, new: list[str]) -> None:
        spread = [(t, u) for t in new for u in units(t)]
        value = self.model.machine.values([u for _, u in spread]).tolist()
        self.known.update(dict.fromkeys(new, self.model.lowest))
        for (t, _), v in zip(spread, value):
            if v > self.known[t]:
                self.known[t] = v

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.machine:
            return self.model.probability(np.zeros(len(texts)))
        if len(self.known) > MEMO:
            self.known = {}
        found = [tokens(t) for t in texts]
        new = list(set().union(*found).difference(self.known))
        for at in range(0, len(new), TOGETHER):
            self.learn(new[at : at + TOGETHER])
        known = self.known
        return self.model.probability(np.array([max(map(known.__getitem__, ts), default=self.model.lowest) for ts in found]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[int, list[str]]]:
    """(label, different words) of the sampled documents, in the order of a hash."""
    marked = picked(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    texts = picked(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).join(texts.select("doc_id"), "doc_id", "left_semi")
    marked = materialize(marked.withColumn("u", F.xxhash64("doc_id")), "labelled")
    few = [marked.where(F.col("label") == k).orderBy("u", "doc_id").limit(settings.per_class) for k in (0, 1)]
    sample = materialize(few[0].unionByName(few[1]), "sample")

    def words(batches):
        schema = pa.schema([("u", pa.int64()), ("doc_id", pa.int64()), ("label", pa.int32()), ("words", pa.string())])

        def rows():
            for batch in batches:
                for u, d, label, text in rows_of(batch, "u", "doc_id", "label", "text", step=16):
                    found = sorted({x for t in tokens(text or "") for x in units(t)}, key=lambda x: (hash_of(x), x))
                    yield u, d, label, "\n".join(sorted(found[: settings.words]))

        yield from batched(rows(), schema)

    own = texts.join(F.broadcast(sample), "doc_id").select("u", "doc_id", "label", F.col("text").cast("string").alias("text"))
    found = own.mapInArrow(words, "u long, doc_id long, label int, words string").groupBy("u", "doc_id", "label").agg(F.min("words").alias("words"))
    rows = sorted(found.collect())
    return [(r["label"], r["words"].split("\n") if r["words"] else []) for r in rows]


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return fit(training_sample(docs, labels, settings), settings)


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): a document's score is that of its worst sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scored(batches):
        scorer = Scorer(shared.value)

        def rows():
            for batch in batches:
                for d, h, t in in_parts(batch):
                    for x in zip(d, h, scorer.scores(t).tolist()):
                        yield *x, int(x[2] >= 0.5)

        yield from batched(rows(), schema)

    plain = picked(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def in_parts(batch: pa.RecordBatch, rows: int = 200, size: int = 1 << 20) -> Iterator[tuple[list, list, list[str]]]:
    """Columns of a few rows at a time, also cut by the characters of their texts."""
    held: list[tuple] = []
    for row in rows_of(batch, "doc_id", "held_out", "text", step=32):
        held.append((row[0], row[1], row[2] or ""))
        if len(held) >= rows or sum(len(x[2]) for x in held[-32:]) > size:
            yield tuple(map(list, zip(*held)))
            held = []
    if held:
        yield tuple(map(list, zip(*held)))


def score_sentences(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, score) of each sentence, in code points of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])

    def scored(batches):
        scorer = Scorer(shared.value)

        def rows():
            for batch in batches:
                for d, t in rows_of(batch, "doc_id", "text", step=32):
                    spans = [m.span() for m in SENTENCE.finditer(t or "")]
                    for (a, b), s in zip(spans, scorer.scores([t[a:b] for a, b in spans]).tolist()):
                        yield d, a, b - a, s

        yield from batched(rows(), schema)

    plain = picked(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(scored, "doc_id long, start long, length long, score double")
