"""Runs of words that repeat with a period, by seeds on diagonals.

A run is a stretch of words of smallest period q (words q apart are the same) and at least ``LEAST`` words and
``FOLD`` periods that no neighbouring word extends. It lies on the diagonal of lag q, as a stretch of at least
max(LEAST - q, (FOLD - 1) * q) places i where word i equals word i + q; that is ``K`` = 16 at the least, over all q.

1. Seeds are grams that occur twice in a document, at the two places one lag apart. Grams of K words serve lags up to
   K, and grams of 2K, 4K, ... words the lags between half of their length and their length: each is no longer than
   the overlap that a run of such a lag guarantees, and no shorter than the lag. Two periods of a stretch that holds
   both in full have a common divisor as period, so in a run of smallest period q the next occurrence of a gram of q or
   more words is exactly q later. One pair an occurrence, with the next one, is enough: the pairs grow with the text,
   not with the square of a gram's occurrences. For the same reason a seed's lag is the smallest period of its run.
2. Grams are numbered exactly (pairs of numbered halves), and a gram is only looked at if both halves occur twice.
3. Seeds are extended to both sides along their diagonal. A table by lag holds how far its diagonal has been covered;
   seeds before that are skipped.

A text is one row and is worked on by one task: 70 to 150 bytes a word, beside the text itself.

Defined cases: words are stretches without ASCII white space; a null or empty text has no words and no runs; a null
doc_id stays null; repeated rows are judged each; other columns are not returned; an empty table gives an empty result;
a very long text is split into words by pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import picked

LEAST, FOLD = 24, 3
#: The shortest overlap of a run with itself, one period on: the least of max(LEAST - q, (FOLD - 1) * q) over all q.
K = min(max(LEAST - q, (FOLD - 1) * q) for q in range(1, LEAST))

#: Bytes of a text that are split at once; words of short texts that are searched together.
PIECE, TOGETHER = 1 << 20, 200_000

WHITE = b" \t\n\r\x0b\x0c"


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists; it is cut between words."""
    at = 0
    while len(text) - at > size:
        stop = at + size
        while stop < len(text) and text[stop] not in WHITE:
            stop += 1
        yield text[at:stop].split()
        at = stop
    yield (text[at:] if at else text).split()


class Diagonals:
    """The runs of several documents, whose words are numbered in one array, one document after another."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.ids, self.ends = ids, ends
        self.sizes = np.diff(ends, prepend=0)

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of each document's runs, by start, then period."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.ends]
        covered: dict[int, int] = {}
        for k, at, lag in self.seeds():
            place, q = int(at), int(lag)
            if place + k <= covered.get(q, 0):
                continue
            doc = int(np.searchsorted(self.ends, place, side="right"))
            first, end = int(self.ends[doc] - self.sizes[doc]), int(self.ends[doc])
            start, stop = self.backward(place, q, first), self.forward(place + k, q, end - q)
            covered[q] = stop
            length = stop - start + q
            if length >= max(LEAST, FOLD * q):
                found[doc].append((start - first, length, q))
        return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]

    def seeds(self) -> Iterator[tuple[int, int, int]]:
        """(gram length, place, lag), by lag and place, the first of neighbouring places only."""
        for k, places, grams in self.repeated():
            order = np.lexsort((places, grams))
            lag = np.diff(places[order])
            fits = (np.diff(grams[order]) == 0) & (lag <= k) & ((lag > k // 2) | (k == K))
            at, lag = places[order][:-1][fits], lag[fits]
            order = np.lexsort((at, lag))
            at, lag = at[order], lag[order]
            first = np.ones(len(at), bool)
            first[1:] = (np.diff(at) != 1) | (np.diff(lag) != 0)
            yield from zip([k] * int(first.sum()), at[first].tolist(), lag[first].tolist())

    def repeated(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, numbers) of the grams of k words that occur twice in a document, for k = K, 2K, 4K, ..."""
        n, k = len(self.ids), 1
        numbers = self.ids.astype(np.int64)
        doc = np.repeat(np.arange(len(self.ends)), self.sizes)
        left = self.ends[doc] - np.arange(n)
        alive = left >= 2
        while alive.any():
            both = np.flatnonzero(alive[: n - k] & alive[k:] & (left[: n - k] >= 2 * k))
            most = int(numbers.max()) + 1
            keys = numbers[both] * most + numbers[both + k]
            if k == 1:
                keys = keys * len(self.ends) + doc[both]  # from here on a number is of one document
            _, codes, counts = np.unique(keys, return_inverse=True, return_counts=True)
            twice = counts[codes] > 1
            k, both, codes = 2 * k, both[twice], codes[twice]
            alive = np.zeros(n, bool)
            alive[both] = True
            numbers[both] = codes
            if k >= K:
                yield k, both, codes

    def forward(self, at: int, q: int, limit: int) -> int:
        """The first place from ``at`` on whose word differs from the one q later."""
        step = 64
        while at < limit:
            stop = min(limit, at + step)
            odd = np.flatnonzero(self.ids[at:stop] != self.ids[at + q : stop + q])
            if len(odd):
                return at + int(odd[0])
            at, step = stop, 2 * step
        return at

    def backward(self, at: int, q: int, first: int) -> int:
        """The first place of the stretch up to ``at``."""
        step = 64
        while at > first:
            low = max(first, at - step)
            odd = np.flatnonzero(self.ids[low:at] != self.ids[low + q : at + q])
            if len(odd):
                return low + int(odd[-1]) + 1
            at, step = low, 2 * step
        return at


def search(texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, text without the repeats, its words joined by single spaces) of each text."""
    vocabulary: dict[bytes, int] = {}
    numbered, sizes = [], []
    for text in texts:
        parts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for words in pieces(text)]
        numbered += parts
        sizes.append(sum(map(len, parts)))
    found = Diagonals(np.concatenate(numbered), np.cumsum(sizes)).runs()
    return [(n, runs, collapse(text, n, runs)) for text, n, runs in zip(texts, sizes, found)]


def collapse(text: bytes, n: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    out, at = [], 0
    for words in pieces(text):
        mask = kept[at : at + len(words)]
        at += len(words)
        out += words if mask.all() else [w for w, k in zip(words, mask.tolist()) if k]
    return b" ".join(out)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each document's runs, and its words without their repeats."""
    plain = picked(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def found(batches):
        for batch in batches:
            for ids, texts in together(batch):
                got = search(texts)
                runs = [[dict(zip(("start", "length", "period"), r)) for r in rs] for _, rs, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([n for n, _, _ in got], pa.int64()), pa.array(runs, schema.field("runs").type), pa.array([c.decode() for _, _, c in got], pa.string())], schema=schema
                )

    return plain.mapInArrow(found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def together(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """The rows of a batch, as many at a time as make up some number of words; a very long text by itself."""
    ids, texts, size = [], [], 0
    for at in range(batch.num_rows):
        text = batch.column(1)[at].as_py()
        if ids and size + len(text) // 6 >= TOGETHER:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(batch.column(0)[at].as_py())
        texts.append(text)
        size += len(text) // 6
    if ids:
        yield ids, texts


def tail_made_periodic(doc_id: Column, text: Column) -> Column:
    """The text, of which one in ten repeats a stretch of its words from some word on: with n words and h the CRC-32 of
    the id, g = h / 10, words from a = g % n on have the period 1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        at = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.element_at(s["w"], (F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]) + 1).cast("int")))
        a = g % n
        made = F.transform(F.array(F.struct(w.alias("w"), n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))), lambda s: F.array_join(at(s), " "))
        return F.when(F.size(w) == 0, "").otherwise(made[0])

    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``periodic_runs``; the
    four in the middle are of the run with the greatest number of periods, the first of equals."""
    best = F.expr(
        "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),"
        " (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    )
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    digested = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return digested.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
