"""The string kernel against plain sums over subsequences, and toxicity on held-out and altered documents."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import string_kernel as sk
from quire.llm.queries import QUERIES

SETTINGS = sk.Settings()


def plain_features(word):
    out = Counter()
    for p in SETTINGS.sizes:
        for at in itertools.combinations(range(len(word)), p):
            leapt = at[-1] - at[0] + 1 - p
            if leapt <= SETTINGS.gap:
                out["".join(word[i] for i in at)] += SETTINGS.decay**leapt
    return out


def plain_kernel(a, b):
    f, g = plain_features(a), plain_features(b)
    return sum(v * g[u] for u, v in f.items())


def test_kernel_is_a_sum_over_subsequences():
    rng = random.Random(4)
    words = ["^idiot$", "^idiiot$", "^i$", "^$", "^aaaaaaaa$", "^日本語テキスト$"] + ["^" + "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 12))) + "$" for _ in range(30)]
    got = sk.landmark_table(words, SETTINGS).sums(words, SETTINGS)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, rtol=1e-4)


def test_folding_loses_nothing():
    machine = sk.fit_machine({"^idiot$": 2.0, "^moron$": 1.0, "^idiots$": 1.0}, ["^garden$", "^riot$", "^patio$", "^more$"], SETTINGS)
    marks = ["^idiot$", "^idiots$", "^moron$", "^garden$", "^riot$", "^patio$", "^more$"]
    words = ["^idxiot$", "^ridiots$", "^morn$", "^zzz$"]
    kernel = np.array([[plain_kernel(w, m) for m in marks] for w in marks + words])
    beta, *_ = np.linalg.lstsq(kernel[: len(marks)], machine.values(marks) - machine.bias, rcond=None)
    assert np.allclose(kernel[len(marks) :] @ beta + machine.bias, machine.values(words), atol=1e-2)
    assert machine.values(["^idiot$"])[0] > 0.8 > 0 > machine.values(["^garden$"])[0]


def test_what_a_token_is_read_as():
    assert sk.units("I-d.i_o-t!") == ["^idiot$"] and sk.units("--") == [] and sk.units("ｉｄｉｏｔ") == ["^idiot$"]
    long = "x" * 5000 + "idiot" + "y" * 5000
    assert any("idiot" in w for w in sk.units(long)) and all(len(w) <= sk.WINDOW for w in sk.units(long))
    assert {"idiot", "you"} <= sk.tokens("you i  d i\to t now") and "ab" not in sk.tokens("a. b. c")
    text = "One two. Three four! five\nsix ... seven"
    assert "".join(text[a:b] for a, b in (m.span() for m in sk.SENTENCE.finditer(text))) == text


@pytest.fixture(scope="module")
def model(spark):
    where = "/root/testdata/sf0.1"
    return sk.train(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))


def test_inserted_characters_and_sentences(spark, model):
    plain = "The garden is of stone and water. "
    bad = ["stupid", "st.u.p.i.d", "s t u p i d", "stuupid", "STUPID", "worthlesss", "w-o-r-t-h-l-e-s-s"]
    rows = [(i, f"{plain * 40}You are {w} now. {plain}") for i, w in enumerate(bad)] + [(100 + i, plain * n) for i, n in enumerate((1, 5, 3000))]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, score int, label string").toDF("doc_id", "text", "Text", "a.b")
    got = {r.doc_id: r for r in sk.score_documents(docs, model).collect()}
    assert [got[i].predicted for i, _ in rows] == [1] * len(bad) + [0] * 3
    worst = {}
    for r in sk.score_sentences(docs, model).collect():
        worst[r.doc_id] = max(worst.get(r.doc_id, (-1,)), (r.score, r.start, r.length))
    assert all(abs(worst[d][0] - r.score) < 1e-9 for d, r in got.items())
    assert all(dict(rows)[d][worst[d][1] :][: worst[d][2]].strip().startswith("You are") for d in range(len(bad)))


def test_held_out_accuracy(spark, model):
    where = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    got = [(r, labels[r.doc_id]) for r in sk.score_documents(spark.read.parquet(f"{where}/documents.parquet"), model).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.5) for r, _ in got)
    toxic = [r.predicted for r, t in got if t]
    clean = [r.predicted for r, t in got if not t]
    assert sum(toxic) > 0.88 * len(toxic) and sum(clean) < 0.04 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "you idiot"), (4, "...!!!"), (5, "you idiot"), (5, "you idiot"), (6, "日本語 😀"), (7, "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace")), (8, "a " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sk.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out
    assert {r.doc_id: r.predicted for r in got} == {1: 0, 2: 0, None: 1, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0}
    assert sk.score_documents(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(d, "some text") for d in range(20)], "doc_id long, text string")
    for labels in ([], [(d, 0) for d in range(20)], [(None, 1), (3, None)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert {r.predicted for r in sk.score_documents(docs, sk.train(docs, table)).collect()} == {0}


def test_query(spark):
    got = QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.columns == ["doc_id", "held_out", "score", "predicted"]
