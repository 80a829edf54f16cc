"""The containment join against every pair, and a suite that one literal can't hold."""

from __future__ import annotations

import random

import numpy as np

from quire.operators import recall as R


def test_against_every_pair(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "ca", "é", "😀x", "dd"]) for _ in range(rng.choice([0, 5, 40, 300]))) for _ in range(60)]
    asked = ["", "ab", "b"]
    for t in texts:
        for n in (3, 20, 39, 40, 41, 60, 150):
            at = rng.randrange(max(1, len(t)))
            asked += [t[at : at + n], t[at : at + n].replace(" ", "")]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    anchors = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    dense = lambda t: "".join(c for c in t.lower() if c.isalnum())
    want = {(i, k) for i, t in enumerate(texts) for k, a in enumerate(asked) if dense(a) in dense(t)}
    hits = R.anchor_hits(docs, anchors)
    assert {tuple(r) for r in R.found_anchors(hits).collect()} == want
    got = [(r.doc_id, r.found, r.total) for r in R.recall(hits).collect()]
    assert sorted(got) == sorted((i, sum(d == i for d, _ in want), len(asked)) for i in [0, *range(len(texts))])
    lacked = {r.doc_id: r.missing for r in R.missing(hits).collect()}
    assert lacked == {i: ",".join(str(k) for k in range(len(asked)) if (i, k) not in want) for i in range(len(texts))}


def test_large_suite(spark):
    anchors = spark.range(160_000).selectExpr("id as item_id", "concat(repeat(concat('anchor', id, 'x'), 20)) as text")
    docs = anchors.where("item_id in (7, 99)").selectExpr("item_id as doc_id", "concat('before ', text, ' after') as text")
    assert sorted((r.doc_id, r.found, r.total) for r in R.recall(R.anchor_hits(docs, anchors)).collect()) == [(7, 1, 160_000), (99, 1, 160_000)]


def test_repeated_documents_are_graded_each(spark):
    from quire.operators import faults as FA

    docs = spark.createDataFrame([(1, "some line here"), (1, "some line here"), (2, "```\nx"), (2, "other"), (None, None), (3, "")], "doc_id long, text string")
    anchors = spark.createDataFrame([(7, "line"), (8, "line"), (9, "absent"), (9, "other")], "item_id long, text string")
    expected = spark.createDataFrame([(1, True), (1, False), (5, True)], "doc_id long, expected boolean")
    hits = R.anchor_hits(docs, anchors)
    scores = FA.grade(docs, R.recall_by_row(hits), expected)
    got = sorted((r.doc_id or 0, r.found, r.faults, r.warned) for r in scores.collect())
    assert got == [(0, 0, "not empty", False), (1, 2, "", True), (1, 2, "", True), (2, 0, "no code fence", False), (2, 1, "", False), (3, 0, "not empty", False)]
    assert FA.announce(scores, R.missing_by_row(hits)).count() == 6
    for size in (1, 4096):
        lacked = sorted((r.doc_id or 0, r.missing) for r in hits.docs.join(R.missing_by_row(hits, size), "_row").collect())
        assert lacked == [(0, "7,8,9,9"), (1, "9,9"), (1, "9,9"), (2, "7,8,9"), (2, "7,8,9,9"), (3, "7,8,9,9")]


def test_short_anchors_in_groups(spark):
    docs = spark.createDataFrame([(1, "abcab"), (2, "xyz"), (3, "")], "_row long, dense string")
    anchors = spark.createDataFrame([(10, "ab"), (11, "ab"), (12, "cab"), (13, "q"), (14, "yz"), (15, "xyzx")], "_item long, dense string")
    for most in (1, 2, 100):
        got = sorted(tuple(r) for r in R.short_hits(docs, anchors, most).collect())
        assert got == [(1, 10), (1, 11), (1, 12), (2, 14)]


def shuffled(spark, after=-1):
    """(bytes that stages after this one wrote to shuffles, last stage)."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    of = [(stages.apply(k).stageId(), stages.apply(k).shuffleWriteBytes()) for k in range(stages.size())]
    return sum(n for k, n in of if k > after), max((k for k, _ in of), default=-1)


def test_anchors_with_a_common_beginning_do_not_meet_each_document(spark):
    """Texts were shuffled for each meeting, and anchors with the same beginning met all documents that have it."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    common = word(100)
    asked = [common + word(120) for _ in range(150)] + [word(60)]
    texts = [word(800) + a + word(800) for a in asked]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "doc_id long, text string")
    anchors = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    before = shuffled(spark)[1]
    got = [tuple(r) for r in R.found_anchors(R.anchor_hits(docs, anchors)).collect()]
    assert sorted(got) == sorted((i + n, i) for i in range(len(asked)) for n in (0, len(asked)))
    assert 0 < shuffled(spark, before)[0] < 2 * sum(map(len, texts)), shuffled(spark, before)


def test_keys_of_windows(monkeypatch):
    monkeypatch.setattr(R, "AT_ONCE", 500)
    rng = random.Random(8)
    texts = ["", "ab", "x" * 3000, *("".join(rng.choice("abé😀") for _ in range(rng.choice([20, 39, 40, 170, 490, 700, 2600]))) for _ in range(60))]
    at, keys = R.text_keys(texts, lambda k: np.ones(len(k), bool))
    of = [set(keys[at == k].tolist()) for k in range(len(texts))]
    assert len(keys) == sum(map(len, of))
    for text, known in zip(texts, of):
        for n in (39, 40, 78, 79, 80, 158, 159, 160, 1000):
            for i in {0, len(text) - n, rng.randrange(len(text) - n + 1)} if len(text) >= n else ():
                assert int(R.anchor_key(text[i : i + n])) in known
