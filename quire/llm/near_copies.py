"""Near copies by SimHash, BK-trees and the Jaccard similarity of word shingles.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; a group of near
copies is what links connect. Candidates come from SimHash: a text's fingerprint has 128 bits that are compared, and
further bits that deal it to a shard of each of several tables. In a task each shard has a BK-tree, as in ``simhash_bk``,
that is asked for the fingerprints within ``RADIUS`` bits. A bit differs for a pair at 0.8 with probability 0.151, so it
is farther than 36 of 128 bits with 0.00005, and the tables are as many as leave it without a common shard with 0.0006.
The bits of a shard's key grow with the number of texts up to ``MOST_BITS``; a shard with far more texts than a tree
should hold is divided in parts that all meet each other. Candidates that hang together are a pool; inside a pool every pair is decided by its exact
similarity, unless links found before join both texts already. A pool of more than ``pool_size`` texts or
``POOL_BYTES`` of text is divided: first each part is decided by itself, then two texts of each group found so far meet, and only pools that are still several
groups have every part meet every other part, so no pair is left out. Links leave a task as a forest.

A group of copies would be found again by every table and every two parts that hold some of it. So the first
``FIRST`` tables are searched before the others, and what they join counts as one in all later searches, as do groups
of links between steps: a later task tells only what joins two of them, and the graphs that label propagation takes
hold these joins alone. Their edges grow with the texts, not with tables or parts.

Most texts are in no pool and aren't marked to go. A Bloom filter of bounded size tells which may be, and only those are
shuffled to meet the pools or the marks exactly; the others stay where they are.

Defined cases: words are split as ASCII and lower-cased, as in ``simhash_bk``; fewer words than a shingle holds give one
shingle of them all; null and empty texts and those without words are copies of each other; a null doc_id stays only if
its group holds no other; of repeated rows one stays; a very long text is split in pieces, and only the hashes of its
shingles are held; other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import batched, rows_of
from quire.llm.bloom_cascade import build_level, hashes, passes
from quire.llm.simhash_bk import components, composed, first_of, forest, pieces
from quire.llm.storage import discard, hot_keys, join_unique, materialize, own_names, pack

SHINGLE = 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)

#: 64-bit words of the fingerprint that trees compare, and the radius of their search.
WORDS, RADIUS = 2, 36
#: Chance that a bit of SimHash is equal for two sets of one size at ``LEAST``, whose cosine is 2 s / (1 + s).
AGREE = 1 - math.acos(2 * LEAST[0] / (LEAST[0] + LEAST[1])) / math.pi
#: Chance that such a pair is in no common shard; texts of a shard on average; most bits of a shard's key.
MISSED, SHARD, MOST_BITS = 0.0006, 256, 16
#: Texts that a tree holds about; a shard with more than twice as many is divided.
TREE_SIZE = 2048

#: Tables that are searched before the others.
FIRST = 4

#: Bytes of text that a part of a pool holds about; a longer text is a part by itself or with few others.
POOL_BYTES = 16 << 20

#: Share of other keys that a Bloom filter lets pass, as long as it fits ``FILTER_BYTES``; beyond that it keeps its
#: size and lets more pass, so that more texts are shuffled and the result is the same.
FILTER_RATE, FILTER_BYTES = 0.02, 16 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; at least one."""
    hashed = [np.zeros(0, np.uint64)]
    for words in pieces(text):
        known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
        hashed.append(np.array([known[w] for w in words], np.uint64))
    hashes = np.concatenate(hashed)
    size = min(size, len(hashes))
    spans = len(hashes) - size + 1
    out = np.full(spans, size, np.uint64)
    for i in range(size):
        out = mixed(out * MULTIPLIER + hashes[i : i + spans])
    return np.unique(out)


def tables(count: int) -> tuple[int, int]:
    """(bits, number): the bits of a shard's key for ``count`` texts, and the tables that a pair at ``LEAST`` needs."""
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(2, count) / SHARD))))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-(AGREE**bits)))


_number = WORDS + -(-MOST_BITS * tables(SHARD << MOST_BITS)[1] // 64)
_random = np.random.default_rng(42)
FACTORS = _random.integers(0, 1 << 64, _number, np.uint64) | np.uint64(1)
OFFSETS = _random.integers(0, 1 << 64, _number, np.uint64)
#: For each byte, a word whose bytes are its bits, so that a sum of up to 255 such words counts each bit.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def simhash(found: np.ndarray, words: int) -> np.ndarray:
    """The first ``words`` words of the SimHash of a set of hashes: a bit is 1 if over half of the hashes of its word set it."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(found), 255):
        hashed = mixed(found[at : at + 255, None] * FACTORS[:words] + OFFSETS[:words])
        counts += SPREAD[hashed.view(np.uint8)].sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)


def band_keys(found: np.ndarray, bits: int = MOST_BITS, number: int | None = None, fingerprint: np.ndarray | None = None) -> np.ndarray:
    """The shard of a set of hashes in each table: the table's own ``bits`` of SimHash, after those that trees compare."""
    number = number or tables(SHARD << bits)[1]
    whole = simhash(found, WORDS + -(-bits * number // 64)) if fingerprint is None else fingerprint
    own = np.unpackbits(whole[WORDS:].view(np.uint8), count=bits * number, bitorder="little").reshape(number, bits)
    return (np.arange(number) << bits) + own @ (1 << np.arange(bits))


def may_hold(keys: DataFrame, most: int = FILTER_BYTES) -> Callable[[str], Column]:
    """A test of whether a 64-bit column's value may be among ``keys`` (key), by a broadcast Bloom filter of at most ``most``
    bytes: true for every one of them, and wrongly for few others."""
    count = keys.count()
    rate = max(FILTER_RATE, math.exp(-8 * most * math.log(2) ** 2 / max(1, count)))
    level = build_level(keys.select(*hashes(F.col("key"))), count, min(rate, 0.99), 0)
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def held(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, h1.to_numpy(), h2.to_numpy()))

    return lambda column: held(*hashes(F.col(column)))


def sketches(docs: DataFrame, bits: int, number: int) -> DataFrame:
    """(tie, n_bytes, w0, w1, keys) of (tie, text): the words that trees compare, and the shard in each table."""
    schema = pa.schema([("tie", pa.int64()), ("n_bytes", pa.int64()), ("w0", pa.int64()), ("w1", pa.int64()), ("keys", pa.list_(pa.int32()))])
    words = WORDS + -(-bits * number // 64)

    def sketched(batches):
        def rows():
            for batch in batches:
                for tie, text in rows_of(batch, "tie", "text"):
                    found = shingles(text)
                    whole = simhash(found, words)
                    yield tie, len((text or "").encode()), *whole[:WORDS].view(np.int64).tolist(), band_keys(found, bits, number, whole)

        yield from batched(rows(), schema)

    return docs.mapInArrow(sketched, "tie long, n_bytes long, w0 long, w1 long, keys array<int>")


def units_of(batches: Iterator[pa.RecordBatch], unit: list[str], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns ``names`` of each run of rows with equal ``unit``, which may go on in the next batch."""
    last, held = None, []
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
        keys, rows = np.stack([column(c) for c in unit], axis=1), [column(c) for c in names]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, stop in itertools.pairwise([0, *cuts.tolist(), len(keys)] if len(keys) else []):
            if held and (keys[start] != last).any():
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            last = keys[start]
            held.append([r[start:stop] for r in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def near_fingerprints(fps: np.ndarray, part: np.ndarray, radius: int = RADIUS, visits: int = 1 << 19, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Forest edges (place, place) of the rows of ``fps`` that differ in at most ``radius`` bits, by a BK-tree of one part
    that is asked for the other, or for itself if there is one part. Rows with equal ``own`` count as connected."""
    own = np.arange(len(fps)) if own is None else own
    if len(own) == 0 or (own == own[0]).all():
        return []
    order = np.lexsort((own, *fps.T))
    new = np.r_[True, (fps[order[1:]] != fps[order[:-1]]).any(axis=1)]
    first = order[new]
    # Of equal fingerprints each other owner has one edge to the first row.
    told = ~new & np.r_[False, own[order[1:]] != own[order[:-1]]]
    edges = list(zip(first[np.cumsum(new) - 1][told].tolist(), order[told].tolist()))
    # A fingerprint that both parts hold counts for one of them: its pairs within a part are that part's own unit's.
    same = part.min() == part.max()
    tree = first[part[first] == part.min()]
    queries = tree if same else first[part[first] != part.min()]
    if len(first) > 1 and len(tree) and len(queries):
        both = tree if same else np.concatenate([queries, tree])
        found = forest(fps[tree], fps[queries], radius, max(1, visits // len(tree)), same, own[both])
        edges += [(int(both[x]), int(both[y])) for x, y in found]
    return edges


def near_edges(units: DataFrame) -> DataFrame:
    """Edges (a, b, x, y) of the near fingerprints of each unit (key, i, j, part, tie, own, w0, w1): x and y are the owners
    of the ties a and b, and each two owners have one edge at most."""
    schema = pa.schema([(c, pa.int64()) for c in "abxy"])

    def trees(batches):
        def rows():
            for tie, own, part, *words in units_of(batches, ["key", "i", "j"], ["tie", "own", "part", "w0", "w1"]):
                if len(tie) > 1:
                    for p, q in near_fingerprints(np.stack(words, axis=1).view(np.uint64), part, own=own):
                        p, q = (p, q) if own[p] < own[q] else (q, p)
                        yield int(tie[p]), int(tie[q]), int(own[p]), int(own[q])

        yield from batched(rows(), schema)

    by_unit = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = by_unit.mapInArrow(trees, "a long, b long, x long, y long")
    one = found.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("e"))
    return materialize(one.select("e.a", "e.b", "x", "y"), "candidates")


def searched(sketched: DataFrame, tree_size: int = TREE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): edges (a, b) that connect the texts whose fingerprints are near and which share a shard of any
    table, and the (node, label) that they join."""
    fps = materialize(sketched.select("tie", "w0", "w1", "keys").distinct(), "distinct")
    # Crowded shards are told by a sixteenth of the texts; which are divided changes no pair, only who meets where.
    n = F.count("*") * 16
    some = fps.where(F.pmod("tie", F.lit(16)) == 0).select(F.explode("keys").alias("key"))
    crowded = materialize(some.groupBy("key").agg(n.alias("n")).where(F.col("n") > 2 * tree_size).select("key", F.ceil(F.col("n") / tree_size).cast("int").alias("parts")), "crowded")
    any_crowded, none = not crowded.isEmpty(), F.lit(0)
    row = ["key", "i", "j", "part", "tie", "own", "w0", "w1"]

    def units(dealt: DataFrame) -> DataFrame:
        return dealt.join(F.broadcast(crowded), "key", "left_anti").select("key", none.alias("i"), none.alias("j"), none.alias("part"), *row[4:])

    def divided(dealt: DataFrame) -> DataFrame:
        return dealt.join(F.broadcast(crowded), "key").withColumn("part", F.pmod(F.xxhash64("key", "tie"), "parts").cast("int"))

    def all_units(dealt: DataFrame, least: int = 0) -> DataFrame:
        apart = F.filter(F.sequence(none, F.col("parts") - 1), lambda j: F.abs(F.col("part") - j) >= least)
        meet = F.transform(apart, lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
        return divided(dealt).select("key", "part", *row[4:], F.inline(meet)).select(row)

    # First each part of a few tables by itself, where a large group has an edge a text and table at most.
    first = fps.select(F.explode(F.slice("keys", 1, FIRST)).alias("key"), "tie", F.col("tie").alias("own"), "w0", "w1")
    alone = units(first)
    if any_crowded:
        alone = alone.unionAll(divided(first).select("key", F.col("part").alias("i"), F.col("part").alias("j"), *row[3:]))
    edges = near_edges(alone)
    labels = components(edges.select("a", "b"))
    # Sort-merge at any size: the labels grow with the documents.
    held = may_hold(labels.select(F.col("node").alias("key")))("tie")
    met = fps.where(held).join(labels.withColumnRenamed("node", "tie").hint("merge"), "tie", "left").withColumn("own", F.coalesce("label", "tie")).drop("label")
    owned = materialize(met.unionByName(fps.where(~held).withColumn("own", F.col("tie"))), "owned")
    discard(fps)
    dealt = lambda keys: owned.select(F.explode(keys).alias("key"), *row[4:])
    others = dealt(F.slice("keys", FIRST + 1, F.greatest(F.size("keys") - FIRST, none)))
    rest = units(others)
    if any_crowded:
        rest = rest.unionAll(all_units(others)).unionAll(all_units(dealt(F.slice("keys", 1, FIRST)), 1))
    more = near_edges(rest)
    joined = components(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
    whole = composed(labels, joined)
    discard(owned, crowded, labels, joined)
    return edges.unionAll(more).select("a", "b"), whole


def candidates(sketched: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges (a, b) that connect the texts whose fingerprints are near and which share a shard of any table."""
    return searched(sketched, tree_size)[0]


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, least: tuple[int, int] = LEAST, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs of sets whose similarity is ``least`` or more; ``side`` limits the pairs to unequal sides
    where it has two. Sets with equal ``own`` count as linked."""
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(s) for s in sets])[order]
    owner = np.repeat(np.arange(n), sizes)
    ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    by_id = np.argsort(ids, kind="stable")
    holders = owner[by_id]
    starts = np.searchsorted(ids[by_id], np.arange(ids.max() + 2))
    at = np.concatenate([[0], np.cumsum(sizes)])
    two = side.min() != side.max()
    parent = list(range(n)) if own is None else first_of(own[order]).tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x in range(n - 1):
        # Sizes ascend, so a later set may be at most 1 / least times as large.
        end = int(np.searchsorted(sizes, sizes[x] * least[1] // least[0], side="right"))
        later = np.array([y for y in range(x + 1, end) if root(y) != root(x)], np.int64)
        if two:
            later = later[side[order[later]] != side[order[x]]] if len(later) else later
        if not len(later):
            continue
        mine = ids[at[x] : at[x + 1]]
        lengths = starts[mine + 1] - starts[mine]
        places = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(holders[places], minlength=n)[later]
        union = sizes[x] + sizes[later] - common
        for y in later[common * least[1] >= union * least[0]].tolist():
            r, s = root(x), root(y)
            if r != s:
                parent[max(r, s)] = min(r, s)
                edges.append((int(order[x]), int(order[y])))
    return edges


def decided(units: DataFrame) -> DataFrame:
    """Forest edges (a, b) of the owners of the linked texts of each unit (label, i, j, part, tie, own, text); where it has
    two parts only pairs of both are decided. Texts with equal owners count as linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def decide(batches):
        def of(owns, sets, parts):
            if len(set(owns)) > 1:
                for x, y in linked_pairs(sets, np.array(parts), own=np.array(owns)):
                    yield min(owns[x], owns[y]), max(owns[x], owns[y])

        def rows():
            unit, owns, sets, parts = None, [], [], []
            for batch in batches:
                for label, i, j, own, text, p in rows_of(batch, "label", "i", "j", "own", "text", "part"):
                    if unit != (label, i, j):
                        yield from of(owns, sets, parts)
                        unit, owns, sets, parts = (label, i, j), [], [], []
                    owns.append(own)
                    sets.append(shingles(text))
                    parts.append(p)
            yield from of(owns, sets, parts)

        yield from batched(rows(), schema)

    return units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "tie").mapInArrow(decide, "a long, b long")


def all_parts(members: DataFrame, least: int = 0) -> DataFrame:
    """The units of each part with every other one that is ``least`` parts away or more."""
    apart = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.abs(F.col("part") - j) >= least)
    meet = F.transform(apart, lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    return members.select("label", "part", "tie", "own", "text", F.inline(meet))


def with_parts(members: DataFrame, pool_size: int, pool_bytes: int = POOL_BYTES) -> DataFrame:
    """Add ``parts`` and ``part`` to (tie, label, n_bytes, ...)."""
    parts = F.ceil(F.greatest(F.count("*") / pool_size, F.sum("n_bytes") / pool_bytes, F.lit(1)))
    sizes = materialize(members.groupBy("label").agg(parts.cast("int").alias("parts")), "sizes")
    return join_unique(members, sizes, "label").withColumn("part", F.pmod(F.xxhash64("tie"), F.col("parts")).cast("int"))


def link_groups(texts: DataFrame, pools: DataFrame, pool_size: int = 256, hot: DataFrame | None = None, pool_bytes: int = POOL_BYTES) -> DataFrame:
    """(node, label) of what the linked pairs of the texts (tie, text) of each pool (node, label) connect; ``hot``: ties with
    many rows in ``texts``. Without a column ``n_bytes`` in ``pools`` they are divided by the number of texts only."""
    if "n_bytes" not in pools.columns:
        pools = pools.withColumn("n_bytes", F.lit(0).cast("long"))
    sized = materialize(with_parts(pools.withColumnRenamed("node", "tie"), pool_size, pool_bytes), "pools")
    near = texts.where(may_hold(sized.select(F.col("tie").alias("key")))("tie"))
    # Sort-merge at any size: the pools grow with the documents.
    found = join_unique(near, sized.hint("merge"), "tie", hot)
    members = materialize(found.groupBy("tie", "label", "n_bytes", "parts", "part").agg(F.min("text").alias("text")), "members")
    edges = materialize(decided(members.withColumn("own", F.col("tie")).withColumn("i", F.col("part")).withColumn("j", F.col("part"))), "links")
    discard(sized)
    large = members.where("parts > 1")
    labels = components(edges)
    if large.isEmpty():
        discard(members, edges)
        return labels
    grouped = lambda own: large.join(own.withColumnRenamed("label", "own"), F.col("tie") == F.col("node"), "left").withColumn("own", F.coalesce("own", "tie")).drop("node")

    def joined(before: DataFrame, units: DataFrame) -> DataFrame:
        """The labels after the links that the units find between the groups so far."""
        more = materialize(decided(units).distinct(), "links")
        upper = components(more)
        after = composed(before, upper)
        discard(before, more, upper)
        return after

    ends = grouped(labels).groupBy("label", "own").agg(F.min("tie").alias("x"), F.max("tie").alias("y")).select(F.explode(F.array("x", "y")).alias("tie"), "own").distinct()
    few = materialize(large.join(ends, "tie").select("tie", "own", "label", "n_bytes", "text"), "ends")
    labels = joined(labels, all_parts(with_parts(few, pool_size, pool_bytes)))
    split = materialize(grouped(labels).groupBy("label").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("label"), "split")
    if not split.isEmpty():
        labels = joined(labels, all_parts(grouped(labels).join(split, "label", "left_semi"), 1))
    discard(members, edges, few, split)
    return labels


def groups(texts: DataFrame, pool_size: int = 256) -> DataFrame:
    """(node, label) of the ties in (tie, text) that have near copies: label is one tie of the group."""
    sketched = materialize(sketches(texts, *tables(texts.count())), "sketches")
    edges, found = searched(sketched)
    hot = hot_keys(sketched, "tie")
    sizes = sketched.groupBy(F.col("tie").alias("node")).agg(F.max("n_bytes").alias("n_bytes"))
    pools = materialize(found.join(sizes, "node"), "sized")
    discard(sketched, edges, found)
    labels = link_groups(texts, pools, pool_size, hot)
    discard(pools, hot)
    return labels


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group: that with the least doc_id, then the least text hash.

    Only (doc_id, hash) pairs are grouped and ranked. The documents that may be meant meet the pairs that go, and those
    that stay once of several equal rows; the others aren't shuffled.
    """
    tie = F.xxhash64(F.col(text), F.lit(1))
    hashed = docs.select(tie.alias("tie"), F.col(text).cast("string").alias("text"))
    labels = groups(hashed)
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tie.alias("tie")).groupBy("doc_id", "tie").agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "pairs")
    least = pairs.groupBy("tie").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("best"))
    labelled = materialize(least.join(labels, least["tie"] == labels["node"], "left").select("tie", "best", F.coalesce("label", "tie").alias("label")), "labelled")
    best = materialize(labelled.groupBy("label").agg(F.min("best").alias("best")), "best")
    owners = materialize(join_unique(labelled.select("tie", "label"), best, "label").select("tie", "best"), "owners")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tie") == F.col("best.tie"))
    judged = join_unique(pairs, owners, "tie").withColumn("_stays", stays).where("not _stays or n > 1")
    marks = materialize(judged.select(F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.col("doc_id").isNull().alias("_none"), F.col("tie").alias("_tie"), "_stays", "n"), "marks")
    discard(labels, pairs, labelled, best, owners)
    many = materialize(marks.where(F.col("n") * 1000 > docs.count()), "many")  # fewer than 1,000
    row, at, back = pack(docs)
    id_ = at(doc_id).cast("long")
    tagged = docs.toDF(*own_names(docs)).select(*row).select("_row", F.coalesce(id_, F.lit(0)).alias("_doc"), id_.isNull().alias("_none"), F.xxhash64(at(text), F.lit(1)).alias("_tie"))
    key = ["_doc", "_none", "_tie"]
    tagged = tagged.withColumn("_key", F.xxhash64(*key))
    marked = may_hold(marks.select(F.xxhash64(*key).alias("key")))("_key")
    apart, tagged = tagged.where(~marked).select(*back), tagged.where(marked).drop("_key")
    # Sort-merge at any size: the list of documents that go grows with the documents.
    met = tagged.join(F.broadcast(many), key, "left_anti").join(marks.hint("merge"), key, "left")
    once = met.where(F.col("_stays").isNull()).select(*back)
    first = met.where("_stays").select(*key, "_row").unionAll(tagged.join(F.broadcast(many.where("_stays")), key, "left_semi").select(*key, "_row")).dropDuplicates(key).select(*back)
    return apart.unionAll(once).unionAll(first)
