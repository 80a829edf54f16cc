"""SimHash near-duplicates with BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's word shingles. Linked fingerprints
differ in at most ``radius`` bits. The distinct fingerprints are dealt to shards such that no link is lost: of
``radius + 1`` blocks of bits a linked pair agrees in one at least, hence also in the leading bits of that block, so a
fingerprint goes to one shard for each block. The number of leading bits grows with the corpus, so that shards stay at
about ``tree_size`` fingerprints; a prefix with more of them is dealt by its whole block, and a block value with still
more is divided into parts, each of whose trees is also met by the fingerprints of the other parts.

In a task each shard has a BK-tree, whose children are keyed by the integer Hamming distance to the parent; a query
follows only the edges within the radius of its own distance. Links leave a task as a forest, never as all pairs, and
label propagation with shortcuts joins the forests into components.

Trees travel by the shuffle of their shards. A broadcast of all shard trees would take the fingerprints of all documents
through the driver, however small its groups.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and links like any other; fewer words
than a shingle holds give one shingle of them all; a very long text is hashed in pieces of ``PIECE`` bytes; repeated rows share a fingerprint; a null doc_id is a document that no component is named
after, unless it holds no other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import batched, rows_of
from quire.llm.storage import discard, hot_keys, join_unique, materialize

SEED = 42

#: Bytes of a text that are split into words at once; fingerprints that one tree holds about; queries that go down a
#: tree together.
PIECE, TREE_SIZE, QUERIES = 1 << 20, 32_768, 1024

GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: str | None, size: int = PIECE):
    """Lists of words, with A-Z lower-cased; bytes are split as ASCII, which leaves all other characters alone."""
    data, at = (text or "").encode(), 0
    while at < len(data):
        gap = GAP.search(data, at + size)
        stop = gap.start() if gap else len(data)
        yield data[at:stop].lower().split()
        at = stop


def fingerprint(text: str | None, shingle: int = 3, size: int = PIECE) -> int:
    """64 bits, unsigned."""
    digest, ones, total, words = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for more in pieces(text, size):
        words = words[-(shingle - 1) :] + more if shingle > 1 else more
        some = [digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(some)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches):
        def rows():
            for batch in batches:
                for doc, body in rows_of(batch, "doc_id", "text"):
                    fp = fingerprint(body, shingle)
                    yield doc, fp - (1 << 64) if fp >> 63 else fp

        yield from batched(rows(), schema)

    return docs.selectExpr(f"cast({doc_id} as bigint) as doc_id", f"cast({text} as string) as text").mapInArrow(hashed, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, each of one 64-bit word or a row of several."""
    far = np.bitwise_count(a ^ b)
    if far.ndim == 1:
        return far.astype(np.int64)
    total = far[:, 0].astype(np.int64)
    for k in range(1, far.shape[1]):
        total += far[:, k]
    return total


class BKTree:
    """One node an item. Nodes are built level by level: of the items that took the same edges so far the first becomes
    a node, and the others go on by their distance to it. ``children[node, d]`` to ``children[node, d + 1]`` are the
    nodes below the edge ``d``, of which there is one at most."""

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.place = np.zeros(n, np.int64)  # of a node's item
        self.levels = 0
        width = self.width = 64 * (items.shape[1] if items.ndim > 1 else 1) + 2
        self.children = np.zeros((n, width + 1), np.int32)
        waiting, group, nodes = np.arange(n), np.zeros(n, np.int64), 0
        owners = np.zeros(0, np.int64)
        while len(waiting):
            keys, first, group = np.unique(group, return_index=True, return_inverse=True)
            own = nodes + np.arange(len(keys))
            self.place[own] = waiting[first]
            if self.levels:
                # Nodes of this level are in the order of (parent, distance), which ``keys`` holds as one number.
                counts = np.zeros((len(owners), width), np.int64)
                counts[keys // width, keys % width] = 1
                ends = nodes + np.cumsum(counts, axis=None).reshape(counts.shape)
                self.children[owners, 1:] = ends
                self.children[owners, 0] = np.concatenate([[nodes], ends[:-1, -1]])
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, group = waiting[rest], group[rest]
            far = distances(items[waiting], items[self.place[own][group]])
            group = group * width + far
            owners, nodes = own, nodes + len(own)
            self.levels += 1
        self.values = items[self.place] if n else items
        self.inner = self.children[:, -1] > self.children[:, 0]  # nodes with children

    def near(self, queries: np.ndarray, radius: int):
        """Yield arrays (places of queries, places of items) within the radius; the queries go down together."""
        who, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(who):
            far = distances(queries[who], self.values[node])
            hit = far <= radius
            if hit.any():
                yield who[hit], self.place[node[hit]]
            inner = self.inner[node]
            who, node, far = who[inner], node[inner], far[inner]
            low = self.children[node, np.maximum(far - radius, 0)].astype(np.int64)
            count = self.children[node, np.minimum(far + radius, self.width - 1) + 1] - low
            who, total = np.repeat(who, count), int(count.sum())
            node = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


def first_of(known: np.ndarray) -> np.ndarray:
    """For each place the first one with an equal value."""
    _, first, which = np.unique(known, return_index=True, return_inverse=True)
    return first[which]


def forest(tree_items: np.ndarray, queries: np.ndarray, radius: int, step: int = QUERIES, same: bool = False, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (place, place) over queries, then items, that connect what is linked; at most one for each. If queries and
    items are the ``same``, places are over the items alone. Places with equal ``known`` count as connected."""
    n, first = len(queries), 0 if same else len(queries)
    parent = np.arange(first + len(tree_items)) if known is None else first_of(known)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    tree, edges = BKTree(tree_items), []
    for at in range(0, n, step):
        for who, place in tree.near(queries[at : at + step], radius):
            a, b = who + at, place + first
            # Most hits of a dense shard are joined already; only those with another label are looked at one by one.
            new = parent[a] != parent[b]
            for x, y in zip(a[new].tolist(), b[new].tolist()):
                r, s = root(x), root(y)
                if r != s:
                    edges.append((x, y))
                    parent[max(r, s)] = min(r, s)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
    return edges


def shards(fps: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> tuple[DataFrame, int]:
    """(choice, key, parts, fp): the shards of each distinct fingerprint, and how many of them there are about."""
    total, blocks = fps.count(), radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = min(64 // blocks, max(0, math.ceil(math.log2(max(1, total) / tree_size))))
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    ends = [(((1 << bits) - 1) << (b - bits), ((1 << (b - a)) - 1) << a) for a, b in itertools.pairwise(cuts)]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(signed(p)).alias("key"), F.col("fp").bitwiseAND(signed(w)).alias("block")) for k, (p, w) in enumerate(ends[: blocks if bits else 1])])
    dealt = fps.select("fp", F.inline(keys))
    crowded = materialize(dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * tree_size).select("choice", "key"), "crowded")
    one = F.lit(1).alias("parts")
    if crowded.isEmpty():
        return dealt.select("choice", "key", one, "fp"), blocks << bits
    by_block = dealt.join(crowded, ["choice", "key"], "left_semi").select((F.col("choice") + blocks).alias("choice"), F.col("block").alias("key"), "fp")
    sizes = materialize(by_block.groupBy("choice", "key").agg(F.ceil(F.count("*") / tree_size).cast("int").alias("parts")), "parts")
    rest = dealt.join(crowded, ["choice", "key"], "left_anti").select("choice", "key", one, "fp")
    return rest.unionByName(by_block.join(sizes, ["choice", "key"]).select("choice", "key", "parts", "fp")), (blocks << bits) + sizes.count()


def links(fps: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints that connect every linked pair."""
    sharded, count = shards(fps, radius, tree_size)
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    dealt = sharded.withColumn("part", part).select("choice", "key", "part", "fp", F.inline(units))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def trees(batches):
        def of(unit, fps_, parts):
            i, j = unit[2:]
            items = np.array(fps_, np.int64).view(np.uint64)
            side = np.array(parts)
            tree, queries = (items, items) if i == j else (items[side == i], items[side == j])
            if len(tree) and len(queries) and len(items) > 1:
                both = np.concatenate([queries, tree]).view(np.int64)
                for x, y in forest(tree, queries, radius):
                    if both[x] != both[y]:
                        yield int(both[x]), int(both[y])

        def rows():
            unit, held, parts = None, [], []
            for batch in batches:
                for *found, fp, p in rows_of(batch, "choice", "key", "i", "j", "fp", "part", step=4096):
                    if unit != found:
                        if unit is not None:
                            yield from of(unit, held, parts)
                        unit, held, parts = found, [], []
                    held.append(fp)
                    parts.append(p)
            if unit is not None:
                yield from of(unit, held, parts)

        yield from batched(rows(), schema)

    tasks = min(count, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_unit = dealt.repartition(tasks, "choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j", "fp")
    return by_unit.mapInArrow(trees, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``edges`` (a, b): label is one node of the component.

    Each round hooks trees on their neighbours' grandparents and shortcuts, so the rounds grow with the logarithm of
    the longest path; minima are aggregated before the shuffle, and each round is a table in the shared folder that is
    deleted when the next is written. Nodes with many edges and labels with many nodes are joined apart from the rest.
    """
    both = materialize(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    hubs = hot_keys(both, "b")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    # Labels only fall, so they are at rest when their sum is.
    told = lambda df: df.agg(F.count("*"), F.sum(F.col("label").cast("decimal(38,0)"))).first()
    nodes, total = told(labels)
    while True:
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        crowded = hot_keys(labels, "label", nodes)
        seen = materialize(join_unique(labels, upper, "label", crowded).select("node", "label", "grand"), "grand")
        near = join_unique(both, seen.select(F.col("node").alias("b"), F.col("grand").alias("offer")), "b", hubs).groupBy("a").agg(F.min("offer").alias("offer"))
        moves = seen.join(near, seen["node"] == near["a"]).select(F.inline(F.array(
            F.struct(F.col("node"), F.least("offer", "grand").alias("label")),
            F.struct(F.col("label").alias("node"), F.least("offer", "grand").alias("label")),
        )))
        moved = materialize(moves.unionAll(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        discard(labels, crowded, seen)
        labels = moved
        before, (_, total) = total, told(labels)
        if total == before:
            discard(both, hubs)
            return labels


def composed(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """(node, label) after the labels in ``labels`` (node, label), and nodes that it lacks, were joined by ``upper`` (node, label)."""
    named = upper.select(F.col("node").alias("label"), F.col("label").alias("top"))
    tops = materialize(labels.select("label").distinct().join(named, "label", "left").select("label", F.coalesce("top", "label").alias("top")), "tops")
    moved = join_unique(labels, tops, "label").select("node", F.col("top").alias("label"))
    out = materialize(moved.unionAll(upper.join(labels, "node", "left_anti").select("node", "label")), "composed")
    discard(tops)
    return out


def owners(by_doc: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints in (doc_id, fp)."""
    fps = materialize(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(fps.select("fp"), radius))
    labelled = materialize(fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    named = materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "named")
    return materialize(join_unique(labelled, named, "label").select("fp", "component_id"), "owners")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the least doc_id reachable over links."""
    by_doc = materialize(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    named = join_unique(by_doc, owners(by_doc, radius), "fp")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
