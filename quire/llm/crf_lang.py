"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and, if the training lexicon holds it, itself; their hashed
weights give a score for each language. Learned transitions tie neighbouring words together, and forward-backward
gives each word's distribution over languages, so that runs of another language in code-switched text are labelled
as such. A document's language is the one with the largest share of the marginals, weighted by word length; the
score is that share.

A text is labelled in chains of ``CHAIN`` words, which go through forward-backward side by side.

Training takes a bounded sample: ``most_docs`` different labelled documents in all, at most ``per_lang`` of each language, chosen by
a hash; of a longer text than ``span`` characters its middle is taken, or what follows the first letter if there is none. Every language that has a labelled text with a
letter is learned. Half of the training sequences are spliced from spans of different languages, which is what the
transitions are learned from. Gradients are summed over ``batch`` sequences at a time, so that the memory of training
grows with the number of languages only by the model itself (``buckets`` weights a language).

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is nothing to
learn from; ties go to the first language in order; a run of more than 64 letters is several words; a very long text is
read in pieces; a null doc_id counts as not held out; rows with a null lang are predicted, but not learned from; repeated
rows are predicted each; other columns are ignored or kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain as joined_lists
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrow import batched
from quire.llm.storage import materialize

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,63}")
#: The same words where a lower-case text is all ASCII.
ASCII_WORD = re.compile(r"[a-z]{1,64}")
SPACE = regex.compile(r"\s")
UNDETERMINED = "und"

#: Words that a task remembers the scores of; features that it remembers the buckets of; words of a chain; characters of
#: a text that are read at once.
MEMO, FEATURES, CHAIN, PIECE = 250_000, 250_000, 1024, 1 << 20


@dataclass(frozen=True)
class Settings:
    per_lang: int = 150
    most_docs: int = 2400
    span: int = 20_000
    batch: int = 512
    buckets: int = 1 << 16
    lexicon: int = 20_000
    window: int = 64
    rounds: int = 60
    rate: float = 0.2
    l2: float = 1e-3
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def chains(text: str | None, piece: int = PIECE, chain: int = CHAIN):
    """Lists of at most ``chain`` words; a longer text than ``piece`` is cut at white space where there is some near."""
    text, at = text or "", 0
    while at < len(text):
        gap = SPACE.search(text, at + piece, at + piece + 1000)
        stop = gap.start() if gap else at + piece
        words = words_of(text[at:stop])
        yield from (words[k : k + chain] for k in range(0, len(words), chain))
        at = stop


class Buckets(dict):
    """The bucket of a feature; those of a bounded number of features are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        found = zlib.crc32(feature.encode()) % self.buckets
        if len(self) < FEATURES:
            self[feature] = found
        return found


def features(word: str, lexicon: frozenset[str], buckets: Buckets | int) -> list[int]:
    """Buckets of the affixes (up to 4 letters), n-grams (2 and 3, with word ends) and the lexicon entry."""
    buckets, edged = Buckets(buckets) if isinstance(buckets, int) else buckets, f"<{word}>"
    pairs = list(map(add, edged, edged[1:]))
    found = {*pairs, *map(add, pairs, edged[2:])}
    found.update(("p" + word[:1], "p" + word[:2], "p" + word[:3], "p" + word[:4], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:], "s" + word[-4:]))
    if word in lexicon:
        found.add("w" + word)
    return list(map(buckets.__getitem__, found))


def flattened(ids: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of lists, of which none is held: many small ones at once are slow to collect."""
    lengths: list[int] = []
    noted = (lengths.append(len(x)) or x for x in ids)
    return np.fromiter(joined_lists.from_iterable(noted), np.int64), np.array(lengths)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of sequences padded to (n, t, labels), longest first; with ``pairs`` also the expected transitions."""
    n, t, labels = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    a, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    active = [int(np.searchsorted(-sizes, -k, side="left")) for k in range(t + 1)]  # sequences with more than k words
    alpha, beta, norm = np.zeros_like(e), np.ones_like(e), np.ones((t, n, 1), e.dtype)
    alpha[0] = first * e[0]
    for k in range(t):
        m = active[k]
        if k:
            alpha[k, :m] = (alpha[k - 1, :m] @ a) * e[k, :m]
        norm[k, :m] = alpha[k, :m].sum(axis=1, keepdims=True)
        alpha[k, :m] /= norm[k, :m]
    for k in range(t - 2, -1, -1):
        m = active[k + 1]
        beta[k, :m] = (e[k + 1, :m] * beta[k + 1, :m] / norm[k + 1, :m]) @ a.T
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
    expected = None
    if pairs:
        expected = np.zeros((labels, labels))
        for k in range(t - 1):
            m = active[k + 1]
            expected += alpha[k, :m].T @ (e[k + 1, :m] * beta[k + 1, :m] / norm[k + 1, :m])
        expected *= a
    return gamma.transpose(1, 0, 2), expected


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (buckets, languages)
    start: np.ndarray
    trans: np.ndarray
    lexicon: frozenset[str]

    def word_scores(self, words: list[str], buckets: Buckets | None = None) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        buckets = Buckets(len(self.weights)) if buckets is None else buckets
        flat, lengths = flattened(features(w, self.lexicon, buckets) for w in words)
        return np.add.reduceat(self.weights[flat], np.cumsum(lengths) - lengths, axis=0)


def splice(texts: list[tuple[list[str], int]], settings: Settings) -> list[tuple[list[str], list[int]]]:
    """Training sequences of ``window`` words: windows of single documents, and as many from spans of several."""
    rng, size, out = np.random.default_rng(settings.seed), settings.window, []
    for words, lang in texts:
        out += [(words[i : i + size], [lang] * len(words[i : i + size])) for i in range(0, len(words), size)]
    pool = [x for x in texts if len(x[0]) >= 4]
    for _ in range(len(out) if pool else 0):
        words, labels = [], []
        while len(words) < size:
            own, lang = pool[int(rng.integers(len(pool)))]
            span = int(rng.geometric(1 / 16)) + 2
            at = int(rng.integers(max(1, len(own) - span)))
            part = own[at : at + span][: size - len(words)]
            words += part
            labels += [lang] * len(part)
        out.append((words, labels))
    return out


def fit(sample: list[tuple[str, str]], settings: Settings = Settings()) -> Model | None:
    """A model of (text, language) pairs, by ascent of the conditional likelihood over all of them; None if none has a word."""
    texts = [(w, lang) for text, lang in sorted(sample) if (w := words_of(text))]
    langs = sorted({lang for _, lang in texts})
    if not langs:
        return None
    code = {x: k for k, x in enumerate(langs)}
    counts = Counter(w for words, _ in texts for w in words)
    lexicon = frozenset(w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: settings.lexicon] if n > 2)
    sequences = sorted(splice([(w, code[x]) for w, x in texts], settings), key=lambda s: -len(s[0]))
    vocabulary = {w: k for k, w in enumerate(counts)}
    sizes = np.array([len(w) for w, _ in sequences])  # longest first
    n, labels, flat_words = len(sequences), len(langs), np.array([vocabulary[w] for words, _ in sequences for w in words], np.int32)
    flat_truth = np.array([x for _, ls in sequences for x in ls], np.int32)
    ends = np.cumsum(sizes)
    buckets = Buckets(settings.buckets)
    flat, lengths = flattened(features(w, lexicon, buckets) for w in vocabulary)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    used, flat = np.unique(flat, return_inverse=True)

    def slopes(scores: np.ndarray, start: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
        """Truth less expectation of (words, start, transitions), summed over ``batch`` sequences at a time."""
        by_word, starts, steps = np.zeros((len(lengths), labels)), np.zeros(labels), np.zeros((labels, labels))
        for low in range(0, n, settings.batch):
            some = sizes[low : low + settings.batch]
            mask = np.arange(int(some[0]))[None, :] < some[:, None]
            inside = slice(int(ends[low] - sizes[low]), int(ends[low + len(some) - 1]))
            place, truth = np.zeros(mask.shape, np.int32), np.zeros(mask.shape, np.int32)
            place[mask], truth[mask] = flat_words[inside], flat_truth[inside]
            gamma, expected = forward_backward(scores[place], some, start, trans, pairs=True)
            gap = -gamma[mask].astype(np.float64)
            gap[np.arange(len(gap)), flat_truth[inside]] += 1
            for k in range(labels):
                by_word[:, k] += np.bincount(flat_words[inside], gap[:, k], len(lengths))
            starts += np.bincount(truth[:, 0], minlength=labels) - gamma[:, 0].sum(axis=0)
            both = mask[:, 1:]
            np.add.at(steps, (truth[:, :-1][both], truth[:, 1:][both]), 1)
            steps -= expected
        return [np.stack([np.bincount(flat, by_word[owner, k], len(used)) for k in range(labels)], axis=1), starts, steps]

    params = [np.zeros((len(used), labels)), np.zeros(labels), np.zeros((labels, labels))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, settings.rounds + 1):
        scores = np.add.reduceat(params[0][flat], at, axis=0)
        for p, g, m, v in zip(params, slopes(scores.astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32)), first, second):
            g = g / n - settings.l2 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((settings.buckets, labels), np.float32)
    weights[used] = params[0]
    return Model(langs, weights, params[1].astype(np.float32), params[2].astype(np.float32), lexicon)


class Labeller:
    """Predicts with a model; remembers the scores of a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.known, self.scores, self.filled = model, {}, np.zeros((1024, len(model.langs)), np.float32), 0
        self.buckets = Buckets(len(model.weights))

    def places(self, words: list[str]) -> np.ndarray:
        if new := list(set(words).difference(self.known)):
            while self.filled + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[self.filled : self.filled + len(new)] = self.model.word_scores(new, self.buckets)
            self.known.update(zip(new, range(self.filled, self.filled + len(new))))
            self.filled += len(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None], cells: int = 200_000) -> list[tuple[str, float]]:
        """Chains of like length go through forward-backward together, about ``cells`` words at a time."""
        sums = np.zeros((len(texts), len(self.model.langs)))
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for words in chains(text):
                waiting.append((i, words))
                size += len(words)
                if size >= cells:
                    self._add(waiting, sums, cells)
                    waiting, size = [], 0
        self._add(waiting, sums, cells)
        weight = sums.sum(axis=1)
        share = sums / np.maximum(weight, 1e-30)[:, None]
        return [(self.model.langs[k], min(1.0, top)) if w else (UNDETERMINED, 0.0) for k, top, w in zip(share.argmax(axis=1).tolist(), share.max(axis=1).tolist(), weight.tolist())]

    def _add(self, waiting: list[tuple[int, list[str]]], sums: np.ndarray, cells: int) -> None:
        """Add the chains' marginals, weighted by word length, to their texts' sums."""
        if self.filled > MEMO:
            self.known, self.filled = {}, 0
        waiting.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(waiting):
            some = waiting[at : at + max(1, cells // len(waiting[at][1]))]
            at += len(some)
            sizes = np.array([len(w) for _, w in some])
            mask = np.arange(int(sizes[0]))[None, :] < sizes[:, None]
            place = np.zeros(mask.shape, np.int64)
            joined = [w for _, words in some for w in words]
            place[mask] = self.places(joined)
            gamma, _ = forward_backward(self.scores[place], sizes, self.model.start, self.model.trans)
            weight = np.zeros(mask.shape, np.float32)
            weight[mask] = list(map(len, joined))
            np.add.at(sums, [i for i, _ in some], np.einsum("nt,ntl->nl", weight, gamma))

    def label(self, text: str) -> list[tuple[str, str]]:
        """(word, language) along a text."""
        words = words_of(text)
        if not words:
            return []
        gamma, _ = forward_backward(self.scores[self.places(words)][None], np.array([len(words)]), self.model.start, self.model.trans)
        return [(w, self.model.langs[k]) for w, k in zip(words, gamma[0].argmax(axis=1).tolist())]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(text, language) of at most ``per_lang`` different labelled texts of each language, by the order of a hash; one at least.

    The order is that of the hashes of (doc_id, text), each once, so that equal rows are one choice. Of a long text the middle
    is taken, or if that holds no letter, what follows the first one. Hashes that can't be among the first of
    their language are left out before they are ranked, and only the chosen rows' texts move.
    """
    body, letter = F.col(text), r"\p{L}"
    middle = F.when(F.length(body) > settings.span, F.substr(body, F.floor((F.length(body) - settings.span) / 2).cast("int") + 1, F.lit(settings.span))).otherwise(body)
    span = F.when(middle.rlike(letter), middle).otherwise(F.substr(body, F.length(F.regexp_extract(body, r"(?s)\A\P{L}*", 0)) + 1, F.lit(settings.span)))
    usable = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & body.rlike(letter)).select(F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("h"), span.alias("text"))
    known = materialize(usable.select("lang", "h").distinct(), "labelled")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).persist()  # one row a language
    most = max(1, min(settings.per_lang, settings.most_docs // max(1, counts.count())))
    u = F.pmod(F.col("h"), F.lit(1 << 30)) / (1 << 30)
    least = known.groupBy("lang").agg(F.min(F.struct(u.alias("u"), "h")).alias("least"))
    near = known.join(F.broadcast(counts), "lang").join(F.broadcast(least), "lang").where((u * F.col("n") < 4 * most + 20) | (F.col("h") == F.col("least.h")))
    ranked = near.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(u, "h"))).where(F.col("rn") <= most).select("lang", "h")
    chosen = materialize(ranked, "chosen")  # at most most_docs rows, and one a language
    counts.unpersist()
    rows = usable.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()
    return [(r["text"], r["lang"]) for r in rows]


def train(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return fit(training_sample(docs, settings), settings)


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def labelled(batches):
        labeller = Labeller(shared.value) if shared.value else None

        def rows():
            for batch in batches:
                for part in slices(batch, "text"):
                    texts = part.column(part.schema.get_field_index("text")).to_pylist()
                    found = labeller.predict(texts) if labeller else [(UNDETERMINED, 0.0)] * len(texts)
                    for d, h, (lang, score) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), found):
                        yield d, h, lang, score

        yield from batched(rows(), schema)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(labelled, "doc_id long, held_out boolean, lang_pred string, score double")


def slices(batch: pa.RecordBatch, column: str, rows: int = 2000, size: int = 16 << 20):
    """Parts of a batch that hold about ``size`` bytes at most, one row at least."""
    at, n = 0, max(1, min(rows, int(rows * size / max(1, batch.get_total_buffer_size() / max(1, batch.num_rows) * rows))))
    while at < batch.num_rows:
        yield batch.slice(at, n)
        at += n


def keep_certain(docs: DataFrame, model: Model | None, least: float, text: str = "text") -> DataFrame:
    """The documents, all columns, whose language is determined with a score of ``least`` or more; without a model, those
    with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                certain = [lang != UNDETERMINED and score >= least for lang, score in labeller.predict(texts)] if labeller else [bool(WORD.search(t or "")) for t in texts]
                yield part.filter(pa.array(certain, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
