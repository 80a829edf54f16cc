"""Near copies of the pipeline's stage against the similarity of every pair."""

from __future__ import annotations

import itertools
import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

from quire.llm import near_copies


def spans(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(texts):
    sets, label = [spans(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return label


def copies(seed=5):
    """Texts with copies of one to six edited words, so that similarities lie on both sides of 0.8."""
    rng, out = random.Random(seed), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 90, 200]))]
        out.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(own))
    return out + [None, "", "  "]


def test_stage_finds_near_copies(spark):
    texts = copies()
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0), (None, texts[6], "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    # min(label) names each group after its first text, and the null doc_id's group holds others.
    assert sorted(r.doc_id for r in kept) == sorted(set(plain_groups(texts)))


def test_divided_pools(spark):
    texts = [t or "" for t in copies(6)[:120]]
    rows = spark.createDataFrame(list(enumerate(texts)), "tie long, text string")
    one_pool = spark.createDataFrame([(k, 0) for k in range(len(texts))], "node long, label long")
    found = near_copies.link_groups(rows, one_pool, pool_size=10).collect()
    label = {r.node: r.label for r in found}
    want = plain_groups(texts)
    assert all((label.get(i, i) == label.get(j, j)) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(texts)), 2))


def test_candidates_reach_pairs_at_the_threshold():
    rng, reached, n = np.random.default_rng(3), 0, 400
    for _ in range(n):
        both = rng.integers(0, 1 << 63, 80).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 10).astype(np.uint64)]) for _ in range(2))
        reached += bool((near_copies.band_keys(near_copies.mixed(a)) == near_copies.band_keys(near_copies.mixed(b))).any())
    assert reached >= n - 3


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (2, "A b c d e f", 6), (None, None, 7), (None, "", 8), (4, "x", 9)]
    names = ["doc_id", "text", "_tie"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tie int").withColumn("_key", F.lit("k")).withColumn("_row", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("n", F.lit(3)).withColumn("tie", F.lit(4))
    kept = near_copies.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (tuple(r[n] for n in names) for r in kept.collect()))) in [
        sorted(map(str, [(1, "a b c d e f", 5), none, (4, "x", 9)])) for none in ((None, None, 7), (None, "", 8))]
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_pools_divided_by_bytes(spark):
    texts = [t or "" for t in copies(7)[:60]]
    rows = spark.createDataFrame(list(enumerate(texts)), "tie long, text string")
    one_pool = spark.createDataFrame([(k, 0, len(t)) for k, t in enumerate(texts)], "node long, label long, n_bytes long")
    found = near_copies.link_groups(rows, one_pool, pool_bytes=5000).collect()
    label = {r.node: r.label for r in found}
    want = plain_groups(texts)
    assert all((label.get(i, i) == label.get(j, j)) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(texts)), 2))


def test_filter_never_loses_a_key(spark):
    keys, others = spark.range(0, 5000).select(F.xxhash64("id").alias("key")), spark.range(5000, 15000).select(F.xxhash64("id").alias("key"))
    for most, wrong in ((1 << 20, 400), (1 << 10, 10_000)):
        test = near_copies.may_hold(keys, most)("key")
        assert keys.where(test).count() == 5000
        assert others.where(test).count() <= wrong
    assert others.where(near_copies.may_hold(keys.limit(0))("key")).count() == 0


def test_very_long_copies(spark):
    words = [f"w{k % 9973}" for k in range(400_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.deduplicate(docs).collect()) == [1, 3]


def test_tables_are_deleted(spark):
    from quire.llm.storage import discard, materialize

    table = materialize(spark.range(3), "t")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert Path("/" + folder.lstrip("/")).exists()
    discard(table, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert not Path("/" + folder.lstrip("/")).exists() and Path("/root/testdata/sf0.001/documents.parquet").exists()
