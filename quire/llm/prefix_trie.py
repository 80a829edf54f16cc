"""The trie of conversation prefixes, of which only those that may be shared are shuffled.

1. A turn is hashed (128 bits) where it is read; texts are not moved, but for their beginnings where turns are ordered.
   The digest of a prefix is the exclusive or of its turns' hashes, each taken together with its place. So a prefix's
   parent follows from the prefix and its last turn, and digests can be summed up by pieces of a conversation.
2. A count-min sketch of all prefix digests screens them. An estimate of one proves that a prefix belongs to a single
   conversation, and so do all longer ones: such tails are emitted where they are. An estimate above one proves nothing;
   these prefixes are shuffled and grouped exactly.
3. Sums over subtrees need no walk up the trie: each node's figures are put on the path of its smallest member, summed
   from the end of that path towards its beginning, and the sums of a node's members are added up.

The sketch has four counters a prefix in each of three rows, but ``MOST`` a row at the most (8 MB of bits to broadcast), whatever
the size of the table. A sketch that is too full only lets more prefixes be shuffled; the result is the same.

A conversation may be of any length: turns are dealt by ranges of (conversation, turn), running sums are made in
pieces, and the pieces of the few conversations that lie across a boundary, fewer than there are partitions, are added.
The SHA-256 of a node's ids is a sequence by definition, so it is taken by one task from blocks of ids joined before.

Defined cases: null roles and texts are empty; a null turn is the first; equal turns go by role, then by text (its first
200 code points, then its hash); repeated rows are turns each; rows without a conversation id belong to none and are
left out; a conversation left without turns is a member of the root; other columns are ignored; an empty table has no
nodes; texts of any length are hashed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.storage import materialize, picked

#: Rows of the sketch; the most counters of a row; counters that travel together.
DEPTH, MOST, BLOCK = 3, 1 << 24, 1 << 16

#: SHA-256 of no bytes.
NO_IDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def hashed(*of: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits."""
    return F.xxhash64(F.lit(1), *of), F.xxhash64(F.lit(2), *of)


def running(df: DataFrame, key: str, order: list[str], xors: list[str], sums: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, totals): ``df``, whose columns ``xors`` and ``sums`` have become running values of each key by the order, and
    one row a key with the values of all its rows.

    A key's rows may lie in several pieces. Rows are dealt by ranges, so at most one key lies across each boundary, and
    what is added to pieces after the first has fewer rows than there are partitions.
    """
    columns = [*xors, *sums, "_row"]
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_piece", F.spark_partition_id()).withColumn("_row", F.lit(1).cast("long"))

    def summed(batches):
        last, carried = None, [0] * len(columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            keys = batch.column(at(key)).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            group = np.cumsum(np.bincount(starts, minlength=len(keys))) - 1
            arrays = batch.columns
            for c, column in enumerate(columns):
                values = batch.column(at(column)).to_numpy()
                add = np.bitwise_xor if column in xors else np.add
                whole = add.accumulate(values)
                before = np.concatenate([[0], whole[starts[1:] - 1]])
                own = whole ^ before[group] if column in xors else whole - before[group]
                if last == keys[0]:
                    stop = starts[1] if len(starts) > 1 else len(keys)
                    own[:stop] = add(own[:stop], carried[c])
                carried[c] = own[-1]
                arrays[at(column)] = pa.array(own, pa.int64())
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    rows = materialize(dealt.mapInArrow(summed, dealt.schema), name)
    columns.remove("_row")
    pieces = materialize(rows.groupBy(key, "_piece").agg(*(F.max_by(c, "_row").alias(c) for c in columns)), f"{name}-pieces")
    add = lambda c, other: F.col(c).bitwiseXOR(other) if c in xors else F.col(c) + other
    gather = lambda c: F.bit_xor(c) if c in xors else F.sum(c)
    by_piece = Window.partitionBy(key).orderBy("_piece")
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    later = pieces.select(key, "_piece", F.row_number().over(by_piece).alias("_rank"), *(gather(c).over(before).alias(f"_{c}") for c in columns)).where("_rank > 1").drop("_rank")
    joined = rows.join(F.broadcast(later), [key, "_piece"], "left")
    out = joined.select(*(add(c, F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in columns else F.col(c) for c in df.columns))
    return out, pieces.groupBy(key).agg(*(gather(c).alias(c) for c in columns))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, ord, x1, x2, n_bytes), turns numbered from 1; (conv_id, ord), the number of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x1, x2 = hashed(role, text)
    turns = picked(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), F.substring(text, 1, 200).alias("head"), x1.alias("x1"), x2.alias("x2"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("ord"),
    )
    rows, sizes = running(turns, "conv_id", ["turn", "role", "head", "x1", "x2"], [], ["ord"], "turns")
    return rows.select("conv_id", "ord", "x1", "x2", "n_bytes"), sizes


def rebuild(turns: DataFrame, sizes: DataFrame, most: int = 9, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % 5 in place of its own, h = CRC-32 of c mod 9:
    (conv_id, ord, x1, x2, n_bytes) and (conv_id, ord)."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = sizes.select(F.col("conv_id").alias("base"), F.col("ord").alias("base_ord"))
    convs = sizes.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")
    taken = F.least("h", F.coalesce("base_ord", F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("ord") - F.col("h"), F.lit(0))).alias("n")), "convs")
    own = turns.where(F.col("ord") > h).join(convs.select("conv_id", (F.col("taken") - F.col("h")).alias("shift")), "conv_id").withColumn("ord", F.col("ord") + F.col("shift")).drop("shift")
    first = turns.where(F.col("ord") < most).withColumnRenamed("conv_id", "base")
    taken = first.join(convs.select("conv_id", "base", "h"), "base").where(F.col("ord") <= F.col("h"))
    columns = ["conv_id", "ord", "x1", "x2", "n_bytes"]
    return own.select(columns).unionByName(taken.select(columns)), convs.select("conv_id", F.col("n").alias("ord"))


def prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, depth, last, n_bytes, p1, p2, q1, q2): every prefix of every conversation, the root's too, with its digest
    and its parent's; ``last`` says that the conversation ends here."""
    y1, y2 = hashed("ord", "x1", "x2")
    ends = sizes.select("conv_id", F.col("ord").alias("n"))
    rows = turns.select("conv_id", F.col("ord").alias("depth"), "n_bytes", y1.alias("y1"), y2.alias("y2"))
    none = F.lit(0).cast("long")
    rows = rows.unionByName(sizes.select("conv_id", none.alias("depth"), none.alias("n_bytes"), none.alias("y1"), none.alias("y2")))
    rows = rows.join(ends, "conv_id").select("conv_id", "depth", (F.col("depth") == F.col("n")).alias("last"), "n_bytes", "y1", "y2", F.col("y1").alias("p1"), F.col("y2").alias("p2"))
    summed, _ = running(rows, "conv_id", ["depth"], ["p1", "p2"], [], "prefixes")
    parent = (F.when(F.col("depth") > 0, F.col(f"p{i}").bitwiseXOR(F.col(f"y{i}"))).alias(f"q{i}") for i in (1, 2))
    return summed.select("conv_id", "depth", "last", "n_bytes", "p1", "p2", *parent)


def cells(p1: np.ndarray, p2: np.ndarray, width: int) -> list[np.ndarray]:
    """The counters of digests, one a row of the sketch."""
    mixed = (p1 >> np.uint64(24)) ^ (p2 * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20))
    return [(x & np.uint64(width - 1)).astype(np.int64) for x in (p1, p2, mixed)]


def digests_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    return tuple(batch.column(at(c)).to_numpy().view(np.uint64) for c in ("p1", "p2"))


def shared_counters(rows: DataFrame, width: int) -> np.ndarray:
    """For each counter of the count-min sketch of all digests, whether it counts more than one, in bits."""
    schema = pa.schema([("line", pa.int64()), ("counts", pa.binary())])

    def blocks(held: np.ndarray, pack) -> Iterator[pa.RecordBatch]:
        step = min(BLOCK, width)
        for at in range(0, held.size, step):
            if held[at : at + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // step], pa.int64()), pa.array([pack(held[at : at + step])], pa.binary())], schema=schema)

    def counted(batches):
        held = np.zeros((DEPTH, width), np.uint8)  # counts up to two
        for batch in batches:
            for line, at in zip(held, cells(*digests_of(batch), width)):
                at, n = np.unique(at, return_counts=True)
                line[at] = np.minimum(line[at] + np.minimum(n, 2), 2)
        yield from blocks(held.reshape(-1), lambda x: zlib.compress(x.tobytes(), 1))

    def merged(batches):
        line, total = None, None
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(counts), np.uint8)
                if at != line:
                    if line is not None:
                        yield from done(line, total)
                    line, total = at, np.zeros_like(own)
                total = np.minimum(total + own, 2)
        if line is not None:
            yield from done(line, total)

    def done(line, total):
        yield pa.RecordBatch.from_arrays([pa.array([line], pa.int64()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], schema=schema)

    ddl = "line long, counts binary"
    parts = rows.select("p1", "p2").mapInArrow(counted, ddl).repartition("line").sortWithinPartitions("line").mapInArrow(merged, ddl)
    step = min(BLOCK, width)
    bits = np.zeros((DEPTH * width // step, step // 8), np.uint8)
    for line, counts in parts.collect():  # at most DEPTH * MOST bits
        bits[line] = np.frombuffer(counts, np.uint8)
    return bits.reshape(DEPTH, width // 8)


def screen(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` with ``kind``: 0 may be shared, 1 a single conversation's after one that may be shared, 2 a later one."""
    width = min(most, max(1 << 10, 1 << (4 * rows.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(shared_counters(rows.where("depth > 0"), width))

    def screened(batches):
        conv, depth, alone = None, 0, False  # of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            convs, depths = (batch.column(at(c)).to_numpy() for c in ("conv_id", "depth"))
            proven = np.zeros(len(convs), bool)
            for bits, cell in zip(shared.value, cells(*digests_of(batch), width)):
                proven |= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 0
            proven &= depths > 0
            follows = np.concatenate([[convs[0] == conv and depths[0] == depth + 1], (convs[1:] == convs[:-1]) & (depths[1:] == depths[:-1] + 1)])
            place = np.arange(len(convs))
            start = np.maximum.accumulate(np.where(follows, -1, place))  # of the stretch that a row is in; -1 for the one carried on
            first = np.maximum.accumulate(np.where(proven, place, -1))  # the last one proven up to a row
            single = proven | (first >= np.maximum(start, 0)) | ((start < 0) & alone)
            inner = single & follows & np.concatenate([[alone], single[:-1]])
            conv, depth, alone = convs[-1], depths[-1], bool(single[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single.astype(np.int64) + inner, pa.int64())], names=[*batch.schema.names, "kind"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialize(rows.mapInArrow(screened, f"{names}, kind long"), "screened")


def ids_sha256(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of (p1, p2, conv_id): ids ascending, joined by commas. Blocks of 4,096 ids are joined first."""
    block = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    blocks = ends.groupBy("p1", "p2", F.shiftright("conv_id", 12).alias("block")).agg(block)
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def digested(batches):
        import hashlib

        node, sha = None, None
        for batch in batches:
            for p1, p2, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (p1, p2) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    yield pa.RecordBatch.from_pylist([{"p1": node[0], "p2": node[1], "ends_sha256": sha.hexdigest()}], schema=schema)
                node, sha = (p1, p2), hashlib.sha256(ids.encode())
        if node:
            yield pa.RecordBatch.from_pylist([{"p1": node[0], "p2": node[1], "ends_sha256": sha.hexdigest()}], schema=schema)

    dealt = blocks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "block").select("p1", "p2", "ids")
    return dealt.mapInArrow(digested, "p1 long, p2 long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of screened prefixes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    node = ["p1", "p2"]
    open_rows = rows.where("kind = 0")
    grouped = open_rows.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    )
    grouped = materialize(grouped, "grouped")
    children = grouped.select("q1", "q2").unionByName(rows.where("kind = 1").select("q1", "q2")).where("q1 is not null").groupBy("q1", "q2").agg(F.count("*").alias("n_children"))
    nodes = grouped.join(children.toDF("p1", "p2", "n_children"), node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "nodes")

    known = open_rows.join(nodes.select(*node, F.col("conv_id").alias("least"), "n_convs", "n_children"), node)
    own = F.col("conv_id") == F.col("least")
    figures = known.select(
        "conv_id", (-F.col("depth")).alias("place"), *node, F.when(own, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0).alias("saved_tokens"),
        (own & F.col("last") & (F.col("n_children") == 0)).cast("long").alias("n_leaves"), F.lit(True).alias("open"),
    )
    none = F.lit(0).cast("long")
    tails = rows.where("kind > 0 and last").select("conv_id", (-F.col("depth")).alias("place"), *node, none.alias("saved_tokens"), F.lit(1).cast("long").alias("n_leaves"), F.lit(False).alias("open"))
    summed, _ = running(figures.unionByName(tails), "conv_id", ["place"], [], ["saved_tokens", "n_leaves"], "subtrees")
    subtrees = summed.where("open").groupBy(*node).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = ids_sha256(open_rows.where("last").select(*node, "conv_id"))

    whole = nodes.join(subtrees, node).join(ends, node, "left").select(
        "conv_id", "depth", "q1", "q2", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    )
    one = F.lit(1).cast("long")
    single = rows.where("kind > 0").select(
        "conv_id", "depth", "kind", "q1", "q2", one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_IDS).alias("ends_sha256"),
    )
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    linked = whole.unionByName(single.where("kind = 1").drop("kind")).join(parents, ["q1", "q2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))  # a parent that isn't shared is of the same conversation
    linked = linked.withColumn("parent_conv_id", parent)
    inner = single.where("kind = 2").withColumn("parent_conv_id", F.col("conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return linked.select(columns).unionByName(inner.select(columns))


def prefix_trie(conversations: DataFrame, rebuilt: bool = False, most: int = MOST) -> DataFrame:
    """The trie of (conv_id, turn, role, text), as it is or rebuilt with borrowed beginnings."""
    turns, sizes = numbered_turns(conversations)
    if rebuilt:
        turns, sizes = rebuild(turns, sizes)
    return trie(screen(prefixes(turns, sizes), most))
