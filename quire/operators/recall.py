"""Anchors found in transcripts: a containment join, and its aggregates."""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.sources import tables as T

#: Anchors shorter than a window are searched by automata, of at most so many anchors each: some 2 million nodes.
WINDOW, SHORT = 40, 50_000

#: (characters of a gram, grams of a window, characters of a window): longer anchors meet on longer grams, which fewer texts share.
CLASSES = tuple((gram, grams, gram + grams - 1) for gram, grams in ((24, 16), (48, 32), (96, 64)))

#: Bits of the filter of keys, as a power of two, at most; characters that are hashed at once.
FILTER_BITS, AT_ONCE = 27, 1 << 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Hits:
    """``docs`` (doc_id, _row, _text), ``anchors`` (item_id, _item, _anchor) and which text holds which anchor: ``pairs`` (_text, _anchor).

    ``_row`` and ``_item`` stand for different rows, ``_text`` and ``_anchor`` for different dense texts, so that copies are searched once.
    """

    docs: DataFrame
    anchors: DataFrame
    pairs: DataFrame

    @property
    def found(self) -> DataFrame:
        """(_row, _item) of the anchors that documents hold."""
        rows, items = self.docs.select("_row", "_text").distinct(), self.anchors.select("_item", "_anchor").distinct()
        return rows.join(self.pairs, "_text").join(items, "_anchor").select("_row", "_item")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * MULTIPLIER + b
    out ^= out >> np.uint64(29)
    return out * MULTIPLIER


def least_grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each class, the least hash of a gram in the window that begins at each place."""
    hashes, size, out = {1: codes}, 1, []
    while size < 64:
        h = hashes[size]
        hashes[2 * size] = mixed(h[: max(0, len(h) - size)], h[size:])
        size *= 2
    for gram, grams, _ in CLASSES:
        head, tail = hashes[gram * 2 // 3], hashes[gram // 3]
        n = max(0, len(codes) - gram + 1)
        least, wide = mixed(head[:n], tail[gram * 2 // 3 :][:n]), 1
        while wide < grams:
            least = np.minimum(least[: max(0, len(least) - wide)], least[wide:])
            wide *= 2
        out.append(least)
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def slots(keys: np.ndarray) -> np.ndarray:
    """Places of keys in the largest filter."""
    return mixed(keys, keys >> np.uint64(32)) >> np.uint64(64 - FILTER_BITS)


def anchor_key(text: str) -> np.uint64:
    """A key that any text which contains the anchor, of a window's length at least, has as well."""
    k = max(k for k, c in enumerate(CLASSES) if c[2] <= len(text))
    return least_grams(codes_of(text[: CLASSES[k][2]]))[k][0]


def prepared(anchors: DataFrame) -> DataFrame:
    """(item_id, _item, _anchor, size, head, key, slot, digest) of anchors (item_id, _item, _anchor, dense), as a table: texts are flattened
    once. The last three are null for anchors shorter than a window, which ``head`` holds whole."""
    names = ["item_id", "_item", "_anchor", "size", "head", "key", "slot", "digest"]

    def each(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            long = np.array([len(t) >= WINDOW for t in texts], bool)
            keys = np.array([anchor_key(t) if x else 0 for t, x in zip(texts, long)], np.uint64)
            numbers = [pa.array(c.view(np.int64), mask=~long) for c in (keys, slots(keys))]
            digests = pa.array([hashlib.md5(t.encode()).digest() if x else None for t, x in zip(texts, long)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t) for t in texts], pa.int32()), pa.array([t[:WINDOW] for t in texts], pa.string()), *numbers, digests], names=names)

    made = anchors.select("item_id", "_item", "_anchor", "dense").mapInArrow(each, f"item_id {anchors.schema['item_id'].dataType.simpleString()}, _item long, _anchor long, size int, head string, key long, slot long, digest binary")
    return T.written(made, T.shared_folder(anchors.sparkSession, "anchors"))


def key_filter(wants: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(words, bits): a bit for the keys of each slot, at least 16 bits for each of ``n`` keys. A very large suite lets more pass."""
    bits = min(FILTER_BITS, max(10, (16 * n).bit_length()))
    slot = F.shiftright("slot", FILTER_BITS - bits)
    ones = wants.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((slot >> {FILTER_BITS - bits}) & 63 as int))")).alias("ones")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[ones["word"].to_numpy()] = ones["ones"].to_numpy().view(np.uint64)
    return words, bits


def text_keys(texts: list[str], passes) -> tuple[np.ndarray, np.ndarray]:
    """(index, key) of the keys of texts, each once, that ``passes`` lets through. Texts are hashed side by side, long ones in pieces that overlap."""
    found, held, size = [], [], 0

    def hashed():
        codes = codes_of("".join(piece for _, piece in held))
        lengths = np.array([len(piece) for _, piece in held])
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        at = np.repeat(np.array([k for k, _ in held]), lengths)
        for least, (_, _, window) in zip(least_grams(codes), CLASSES):
            new = left[: len(least)] >= window
            new[1:] &= ~new[:-1] | (least[1:] != least[:-1]) | (at[1 : len(least)] != at[: max(0, len(least) - 1)])
            places = np.flatnonzero(new)
            places = places[passes(least[places])]
            found.append(np.rec.fromarrays([at[places], least[places]], names="at,key"))

    for k, text in enumerate(texts):
        for i in range(0, len(text), AT_ONCE):
            held.append((k, text[i : i + AT_ONCE + CLASSES[-1][2] - 1]))
            size += len(held[-1][1])
            if size >= AT_ONCE:
                hashed()
                held, size = [], 0
    if held:
        hashed()
    unique = np.unique(np.concatenate(found)) if found else np.rec.fromarrays([np.zeros(0, int), np.zeros(0, np.uint64)], names="at,key")
    return unique["at"], unique["key"]


def document_keys(texts: DataFrame, wants: DataFrame, n: int) -> DataFrame:
    """(_text, key) of texts (_text, dense), without those keys that surely none of ``n`` anchors has."""
    words, bits = key_filter(wants, n)
    shared = texts.sparkSession.sparkContext.broadcast((words.tobytes(), bits))
    schema = pa.schema([("_text", pa.int64()), ("key", pa.int64())])

    def each(batches):
        raw, bits = shared.value
        words = np.frombuffer(raw, np.uint64)

        def passes(keys):
            slot = slots(keys) >> np.uint64(FILTER_BITS - bits)
            return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            at, keys = text_keys(batch.column(1).to_pylist(), passes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys.view(np.int64))], schema=schema)

    return texts.select("_text", "dense").mapInArrow(each, "_text long, key long")


def verified(met: DataFrame) -> DataFrame:
    """(_text, _anchor) of the meetings (_text, _anchor, size, head, digest, dense) at which the text holds the anchor."""
    schema = pa.schema([("_text", pa.int64()), ("_anchor", pa.int64())])

    def holds(text, size, head, digest):
        at = text.find(head)
        while 0 <= at <= len(text) - size:
            if hashlib.md5(text[at : at + size].encode()).digest() == digest:
                return True
            at = text.find(head, at + 1)
        return False

    def each(batches):
        for batch in batches:
            keep = pa.array([holds(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return met.select("_text", "_anchor", "dense", "size", "head", "digest").mapInArrow(each, "_text long, _anchor long")


def short_hits(docs: DataFrame, anchors: DataFrame, most: int = SHORT) -> DataFrame:
    """(_row, _item) of the anchors shorter than a window that documents hold, by automata of at most some ``most`` anchors each.

    Each group of anchors is one pass over the documents; a group, and not the suite, is what the driver and a task
    hold at a time.
    """
    groups = max(1, -(-anchors.count() // most))
    dealt = anchors.withColumn("_group", F.pmod(F.col("_item"), F.lit(groups)))
    schema = pa.schema([("_row", pa.int64()), ("_item", pa.int64())])

    def search(group: int) -> DataFrame:
        own = dealt.where(F.col("_group") == group).select("dense", "_item").collect() if groups > 1 else dealt.select("dense", "_item").collect()
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own])

        def hits(batches):
            automaton, items = ahocorasick.Automaton(), {}
            for dense, item in shared.value:
                items.setdefault(dense, []).append(item)
            for dense, of in items.items():
                automaton.add_word(dense, of)
            if items:
                automaton.make_automaton()
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    some = {i for _, of in automaton.iter(text) for i in of} if items else set()
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(sorted(some), pa.int64())], schema=schema)

        return docs.select("_row", "dense").mapInArrow(hits, "_row long, _item long")

    return functools.reduce(DataFrame.unionByName, map(search, range(groups)))


def row_key() -> Column:
    """A key of (doc_id, text), by which what is found out about a document meets its rows."""
    return F.xxhash64("doc_id", "text").alias("_row")


def anchor_hits(docs: DataFrame, anchors: DataFrame) -> Hits:
    """A document holds an anchor if its flattened text does, or does without spaces; the first implies the second.

    Documents and long anchors meet on hashed keys, and each meeting is verified by the anchor's length, beginning and digest, so
    that only documents are shuffled as texts, once; short ones are searched by automata. Empty anchors are in every document.
    """
    dense = F.replace(X.flatten("text"), F.lit(" "), F.lit(""))
    known = docs.select("doc_id", row_key(), dense.alias("dense")).withColumn("_text", F.xxhash64("dense"))
    asked = prepared(anchors.select("item_id", F.xxhash64("item_id", "text").alias("_item"), dense.alias("dense")).withColumn("_anchor", F.xxhash64("dense")))
    each = known.select("_text", "dense").dropDuplicates(["_text"])
    short, empty = F.col("size").between(1, WINDOW - 1), F.col("size") == 0
    wants = asked.where(F.col("size") >= WINDOW).select("_anchor", "key", "slot", "size", "head", "digest")
    n, some_short, some_empty = asked.agg(F.count_if(F.col("size") >= WINDOW), F.count_if(short), F.count_if(empty)).first()
    met = document_keys(each, wants, n).join(wants.drop("slot").dropDuplicates(["_anchor"]), "key").drop("key")
    pairs = verified(met.join(each, "_text"))
    if some_short:
        few = asked.where(short).select(F.col("_anchor").alias("_item"), F.col("head").alias("dense")).dropDuplicates(["_item"])
        pairs = pairs.unionByName(short_hits(each.withColumnRenamed("_text", "_row"), few).toDF("_text", "_anchor"))
    if some_empty:
        pairs = pairs.unionByName(each.select("_text").crossJoin(F.broadcast(asked.where(empty).select("_anchor").distinct())))  # one row
    return Hits(known.drop("dense"), asked.select("item_id", "_item", "_anchor"), pairs)


def found_anchors(hits: Hits) -> DataFrame:
    """(doc_id, item_id) of the anchors that were found."""
    return hits.docs.select("doc_id", "_text").join(hits.pairs, "_text").join(hits.anchors.select("item_id", "_anchor"), "_anchor").select("doc_id", "item_id")


def recall_by_row(hits: Hits) -> DataFrame:
    """(_row, found, total, fraction) of each different document: the fraction of no anchors is 1."""
    copies = hits.anchors.groupBy("_item").agg(F.count("*").alias("copies"))
    counts = hits.found.join(copies, "_item").groupBy("_row").agg(F.sum("copies").alias("n"))
    total = hits.anchors.agg(F.count("*").cast("int").alias("total"))
    n = F.coalesce("n", F.lit(0)).cast("int")
    joined = hits.docs.select("_row").distinct().join(counts, "_row", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select("_row", n.alias("found"), "total", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(n / F.col("total")).alias("fraction"))


def recall(hits: Hits) -> DataFrame:
    """(doc_id, found, total, fraction), a row for each document."""
    return hits.docs.select("doc_id", "_row").join(recall_by_row(hits), "_row").drop("_row")


def missing_by_row(hits: Hits, size: int = 4096) -> DataFrame:
    """(_row, missing) of each different document: the anchors that were not found, in order.

    Anchors are dealt into blocks of about ``size``; a document meets each block once, with what it found of it. That is
    no more work than the answer is long, as a document lacks most of a suite.
    """
    n = max(1, -(-hits.anchors.count() // size))
    block = F.pmod(F.col("_item"), F.lit(n)).alias("block")
    suite = hits.anchors.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("item_id", "_item"))).alias("asked"))
    own = hits.found.groupBy("_row", block).agg(F.collect_set("_item").alias("own"))
    each = hits.docs.select("_row").distinct().select("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    met = each.join(own, ["_row", "block"], "left").join(suite, "block", "left")
    lacked = F.when(F.col("own").isNull(), F.col("asked")).otherwise(F.filter("asked", lambda x: ~F.array_contains("own", x["_item"])))
    ids = F.transform(lacked, lambda x: x["item_id"])
    listed = met.select("_row", F.coalesce(ids, F.array().cast("array<bigint>")).alias("ids"))
    if n > 1:
        listed = listed.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return listed.select("_row", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("missing"))


def missing(hits: Hits) -> DataFrame:
    """(doc_id, missing), a row for each document."""
    return hits.docs.select("doc_id", "_row").join(missing_by_row(hits), "_row").drop("_row")


def repeated(anchors: DataFrame) -> DataFrame:
    """(anchor, n) of the flattened anchors that a suite holds more than once; a sound suite has none."""
    flat = anchors.select(X.flatten("text").alias("anchor"))
    return flat.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
