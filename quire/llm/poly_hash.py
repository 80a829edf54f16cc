"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for a text, the sums of code point times a power of the base before each place, for two moduli.
Two spans are equal if their differences of prefixes agree after shifting to the same power, and the longest common
extension of two places is found by binary search over its length.

A document's fingerprint samples these sums. It holds the hash of the whole text, the hashes of its beginnings and of its
ends at multiples of a step (the power of two that gives 16 to 31 of them; 1 for short texts), and the lengths and hashes
of the spans between places that the content chooses: those where the hash of the ``WINDOW`` code points before has so
many zero bits that spans are about the root of the length. Likeness is the largest share of the longer text that is
covered by equal spans (a multiset, so that moved and scattered parts count), or by the common beginning and end, which
are found by binary search over their nested samples. Spans join to longer ones by their hashes alone, so texts of unlike
lengths are compared at the coarser choice of places. Likeness is 1 for equal whole hashes.

Sums are made for ``BLOCK`` code points at a time and kept only at the places that the fingerprint needs, so a very long
text takes its own size and little more.

Defined cases: a null text is empty; two empty texts are alike (1), an empty and a non-empty one are not (0); a null
doc_id comes first; rows with equal doc_ids are ordered by their texts; a single document is its own next one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import batched, rows_of

# Two primes below 2**31, and a base for each.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)

#: Code points whose sums are made at once; code points before a place whose hash decides whether a span ends there.
BLOCK, WINDOW = 1 << 16, 8
MIX = np.uint64(0x9E3779B97F4A7C15)

#: First characters of a text by which rows with equal doc_ids are divided; sampled rows for each range.
HEAD, SAMPLE = 64, 20

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(k: int, n: int, sign: int = 1) -> np.ndarray:
    """At least the first ``n`` powers (or inverse powers) of base ``k``, by doubling."""
    have = _powers.get((k, sign))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(BASES[k], sign * len(have), MODULI[k])) % np.uint64(MODULI[k])])
        _powers[k, sign] = have
    return have


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Prefixes:
    def __init__(self, text: str | np.ndarray):
        codes = points(text) if isinstance(text, str) else text
        self.n = len(codes)
        self.sums = []
        for k, m in enumerate(MODULI):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * powers(k, self.n)[: self.n] % np.uint64(m)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % np.uint64(m)]))

    def span(self, k: int, start: int, length: int) -> int:
        """The sum over a span, still with the powers of its place."""
        return (int(self.sums[k][start + length]) - int(self.sums[k][start])) % MODULI[k]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62 bits for each span, shifted to the power 0, so that equal spans of any place agree."""
        out = np.zeros(len(starts), np.uint64)
        for k, m in enumerate(MODULI):
            part = (self.sums[k][ends] + np.uint64(m) - self.sums[k][starts]) % np.uint64(m)
            out = out << np.uint64(31) | part * powers(k, self.n + 1, -1)[starts] % np.uint64(m)
        return out


def spans_equal(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] are equal, but for a collision of both moduli."""
    if i + length > a.n or j + length > b.n:
        return False
    return all(a.span(k, i, length) * pow(BASES[k], j, m) % m == b.span(k, j, length) * pow(BASES[k], i, m) % m for k, m in enumerate(MODULI))


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension of a[i:] and b[j:]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if spans_equal(a, i, b, j, mid) else (low, mid - 1)
    return low


def step_of(n: int) -> int:
    return max(1, 1 << max(0, n.bit_length() - 5))


def choice_of(n: int) -> int:
    """Zero bits that a place's hash must end in; spans are about 2 to that power long."""
    return min(14, (n.bit_length() + 1) // 2)


def sampled(codes: np.ndarray, step: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(sums at beginnings, sums at ends by modulus; chosen places, their zero bits and sums) of a text, block by block.

    Beginnings are at multiples of ``step`` and the end, ends at multiples of it from the end. Blocks overlap by a window.
    """
    n, choice = len(codes), choice_of(len(codes))
    heads = np.concatenate([np.arange(step, n + 1, step), [n]])
    tails = n - np.arange(step, n + 1, step)[::-1]
    wanted = np.concatenate([heads, tails])
    order = np.argsort(wanted, kind="stable")
    ascending = wanted[order]
    found = [np.zeros(len(wanted), np.uint64) for _ in MODULI]
    places, zeros, own, before, low = [], [], [], [0] * len(MODULI), 0
    while low < n:
        some = codes[low : low + BLOCK].astype(np.uint64) + np.uint64(1)
        a, b = np.searchsorted(ascending, (low, low + len(some)), side="right")
        for k, m_ in enumerate(MODULI):
            m = np.uint64(m_)
            sums = np.cumsum(some * powers(k, len(some))[: len(some)] % m, dtype=np.uint64) % m
            shift = np.uint64(pow(BASES[k], low, m_))
            moved = lambda at: (np.uint64(before[k]) + shift * sums[at]) % m if low else sums[at]  # noqa: B023, E731
            found[k][a:b] = moved(ascending[a:b] - low - 1)
            if k == 0 and len(some) > WINDOW:
                # The window before a place, shifted to the power 0.
                span = (sums[WINDOW:] + m - sums[:-WINDOW]) % m * powers(0, len(some) + 1, -1)[1 : len(some) - WINDOW + 1] % m
                mixed = (span * MIX) >> np.uint64(40)
                hit = np.flatnonzero((mixed & np.uint64((1 << choice) - 1)) == 0)
                hit = hit[hit + low + WINDOW + 1 < n]
                places.append(hit + (low + WINDOW + 1))
                zeros.append(np.bitwise_count((mixed[hit] & (~mixed[hit] + np.uint64(1))) - np.uint64(1)))
                own.append(moved(hit + WINDOW))
            before[k] = (before[k] + int(shift) * int(sums[BLOCK - WINDOW - 1])) % m_ if len(some) == BLOCK else 0
        low += BLOCK - WINDOW if len(some) == BLOCK else len(some)
    sums = []
    for x in found:
        back = np.empty_like(x)
        back[order] = x
        sums.append(back)
    join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
    return [x[: len(heads)] for x in sums], [x[len(heads) :] for x in sums], join(places, np.int64), np.minimum(join(zeros, np.int64), 14), join(own, np.uint64)


def fingerprint(text: str) -> str:
    """``n:whole:beginnings:ends:spans`` in hex; samples are 32 bits each, a span is its length, the zero bits of its last
    place (f at the end of the text) and a hash of 31 bits; ``*`` tells how often a span repeats."""
    codes = points(text)
    n, step = len(codes), step_of(len(codes))
    heads, tails, places, zeros, own = sampled(codes, step)
    whole = fold_two([h[-1:] for h in heads], np.zeros(1, np.int64))
    first = fold_two([h[:-1] for h in heads], np.zeros(len(heads[0]) - 1, np.int64))
    at = n - np.arange(step, n + 1, step)
    rest = [(h[-1] + np.uint64(m) - t[::-1]) % np.uint64(m) for h, t, m in zip(heads, tails, MODULI)]
    short = lambda h: ((h * MIX) >> np.uint64(32)).astype("<u4").tobytes().hex()
    ends, m = np.concatenate([own, heads[0][-1:]]), np.uint64(MODULI[0])
    starts = np.concatenate([np.zeros(1, np.int64), places])
    spans = (ends + m - np.concatenate([np.zeros(1, np.uint64), own])) % m * inverse_at(0, starts) % m
    sizes = np.concatenate([places, [n]]) - starts
    listed = span_list(sizes.tolist(), [*zeros.tolist(), 15], spans.tolist())
    return f"{n:x}:{int(whole[0]):016x}:{short(first)}:{short(fold_two(rest, at))}:{listed}"


def fold_two(sums: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """62 bits of spans that start at ``starts``, shifted to the power 0."""
    out = np.zeros(len(starts), np.uint64)
    for k, (m, part) in enumerate(zip(MODULI, sums)):
        out = out << np.uint64(31) | part * inverse_at(k, starts) % np.uint64(m)
    return out


def inverse_at(k: int, places: np.ndarray) -> np.ndarray:
    """Inverse powers of base ``k`` at any places, from a table for one block."""
    if not len(places):
        return np.zeros(0, np.uint64)
    top = int(places.max())
    if top < BLOCK:
        return powers(k, top + 1, -1)[places]
    far = np.array([pow(BASES[k], -x * BLOCK, MODULI[k]) for x in range(top // BLOCK + 1)], np.uint64)
    return powers(k, BLOCK, -1)[places % BLOCK] * far[places // BLOCK] % np.uint64(MODULI[k])


def span_list(sizes: list[int], zeros: list[int], hashes: list[int]) -> str:
    listed = [f"{size:x}.{z:x}.{h:x}" for size, z, h in zip(sizes, zeros, hashes)]
    if all(x != y for x, y in itertools.pairwise(listed)):
        return ",".join(listed)
    runs = [(x, sum(1 for _ in same)) for x, same in itertools.groupby(listed)]
    return ",".join(f"{x}*{k:x}" if k > 1 else x for x, k in runs)


@functools.lru_cache(maxsize=8)
def coarse_spans(spans: str, choice: int) -> Counter:
    """How often each (length, hash) comes between places with at least ``choice`` zero bits; a place's bits are known
    up to 14, so all places beyond that count as chosen."""
    m, out, size, h = MODULI[0], Counter(), 0, 0
    for item in spans.split(","):
        one, _, times = item.partition("*")
        n, z, own = one.split(".")
        n, z, own = int(n, 16), int(z, 16), int(own, 16)
        if not size and (z >= choice or z >= 14):
            out[n, own] += int(times or "1", 16)
            continue
        for _ in range(int(times or "1", 16)):
            h = (h + pow(BASES[0], size, m) * own) % m if size else own
            size += n
            if z >= choice or z >= 14:
                out[size, h] += 1
                size, h = 0, 0
    return out


def common_samples(a: list[str], b: list[str], strides: tuple[int, int], size: int) -> int:
    """How many samples agree from the first on, by binary search: agreement is nested."""
    x, y = strides
    low, high = 0, min(len(a) // (8 * x), len(b) // (8 * y), size)
    while low < high:
        mid = (low + high + 1) // 2
        same = a[8 * (mid * x - 1) : 8 * mid * x] == b[8 * (mid * y - 1) : 8 * mid * y]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    (an, aw, ah, at, as_), (bn, bw, bh, bt, bs) = a.split(":"), b.split(":")
    n, m = int(an, 16), int(bn, 16)
    if not n or not m:
        return 0.0
    if (n, aw) == (m, bw):
        return 1.0
    step = max(step_of(n), step_of(m))
    strides = step // step_of(n), step // step_of(m)
    head = common_samples(ah, bh, strides, 1 << 30) * step
    tail = common_samples(at, bt, strides, 1 << 30) * step
    choice = max(choice_of(n), choice_of(m))
    x, y = coarse_spans(as_, choice), coarse_spans(bs, choice)
    spans = sum(size * min(k, y[size, h]) for (size, h), k in x.items())
    return min(max(min(head + tail, min(n, m)), spans) / max(n, m), 1.0)


def range_ends(docs: DataFrame, parts: int, rows: int) -> list[tuple[bool, int, str]]:
    """The last (known, doc_id, head) of each range but the last, from a random sample of about ``SAMPLE`` rows a range."""
    if parts < 2:
        return []
    some = docs.select("doc_id", "head").sample(fraction=min(1.0, SAMPLE * parts / rows), seed=8)
    keys = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["head"]) for r in some.toLocalIterator())
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def with_next(docs: DataFrame, spread: int = 200) -> DataFrame:
    """Sorted partitions (part, guest, doc_id, text) in which a document's next one is the row after it.

    Ranges of (doc_id, first characters of the text) come from a sample, so that many rows without doc_id, or with the
    same, are divided too; only rows that also begin alike stay together. The first document of each range is dealt to
    the range before it as well, as a guest that only serves as the next one, and the first of all to the last range.
    Texts are shuffled once. The number of ranges grows with the root of the bytes of text (divided by ``spread``), so the
    ranges, the sample and the list of their ends stay moderate: 150 ranges at 0.9 GB, 50,000 at 100 TB.
    """
    total, rows = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    parts = max(1, min(math.ceil(math.sqrt(total or 0) / spread), rows or 1))
    docs = docs.withColumn("head", F.substring("text", 1, HEAD))
    ends = range_ends(docs, parts, rows)
    bounds = docs.sparkSession.sparkContext.broadcast(ends)  # one a range
    last_known = docs.sparkSession.sparkContext.broadcast(np.array([i for known, i, _ in ends if known], np.int64))

    @F.pandas_udf("int")
    def range_of(known: pd.Series, ids: pd.Series, head: pd.Series) -> pd.Series:
        # To the left of an end that equals the row, so that equal rows stay together; a null comes first.
        known, ids, nulls = known.to_numpy(), ids.to_numpy(), len(bounds.value) - len(last_known.value)
        low = np.where(known, nulls + np.searchsorted(last_known.value, ids, side="left"), 0)
        high = np.where(known, nulls + np.searchsorted(last_known.value, ids, side="right"), nulls)
        for at in np.flatnonzero(low < high).tolist():
            low[at] = bisect.bisect_left(bounds.value, (bool(known[at]), int(ids[at]), head.iat[at]), int(low[at]), int(high[at]))
        return pd.Series(low.astype(np.int32))

    ranged = docs.withColumn("part", range_of(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "head"))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "head"))
    firsts = ranged.groupBy("part").agg(least.alias("least")).orderBy("part").select("part", "least.*").collect()  # one row a partition
    found = [r["part"] for r in firsts]
    before = dict(zip(found, [found[-1], *found])) if found else {}
    guests = docs.sparkSession.createDataFrame([(r["part"], r["doc_id"], r["head"], before[r["part"]]) for r in firsts], "first_part int, first_id long, first_head string, host int")
    # The least text of the first doc_id and beginning is the first row of a range.
    lead = ranged.join(F.broadcast(guests), (ranged["part"] == guests["first_part"]) & ranged["doc_id"].eqNullSafe(guests["first_id"]) & (ranged["head"] == guests["first_head"]))
    lead = lead.groupBy("part", "host", "doc_id").agg(F.min("text").alias("text")).select(F.col("host").alias("part"), F.lit(True).alias("guest"), "doc_id", "text")
    both = ranged.select("part", F.lit(False).alias("guest"), "doc_id", "text").unionAll(lead)
    return both.repartition(max(len(found), 1), "part").sortWithinPartitions("part", "guest", "doc_id", "text")


def edited(text: str, after: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def fingerprints(docs: DataFrame, spread: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    plain = docs.selectExpr(f"cast({doc_id} as bigint) as doc_id", f"coalesce(cast({text} as string), '') as text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def hashed(batches):
        def rows():
            held = None
            for batch in batches:
                for part, guest, doc, body in rows_of(batch, "part", "guest", "doc_id", "text", step=64):
                    own = fingerprint(body)
                    if held is not None:
                        other = edited(held[1], body)
                        print_ = fingerprint(other)
                        yield held[0], len(held[1]), hashlib.sha256(other.encode()).hexdigest(), held[2], print_, likeness(held[2], print_), likeness(held[2], own)
                    held = None if guest else (doc, body, own)

        yield from batched(rows(), schema)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(plain, spread).mapInArrow(hashed, ddl)
