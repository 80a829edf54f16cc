"""Chat formatting, mixing, URL filters and language identification on small cases, and their defined edge cases."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import adaptive_quality, bloom_cascade, chat_format, crf_lang, poisson_mix

TEXTS = st.text(st.sampled_from(list("<[\\/s>INST] a\n|é")), max_size=30)


def escape(t):
    return re.sub(chat_format.CONTROL, lambda m: m[1] + "\\" + m[2] + m[3], t)


def unescape(t):
    return re.sub(chat_format.ESCAPED, lambda m: m[1] + m[2] + m[3], t)


@given(TEXTS)
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible(t):
    e = escape(t)
    assert unescape(e) == t
    assert not re.search(r"</?s>|\[/?INST\]", e)


def test_chat_round_trip(spark):
    texts = ["</s>", "<\\/s>", "[INST] x [/INST]", "<s><s>", "", None, "a\nb", "[\\\\INST]</s", "<</s>>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(itertools.cycle(["user", "assistant", None, "</s>"]), texts))]
    rows += [(2, None, "assistant", "x"), (2, None, "assistant", "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash")).withColumn("_parts", F.lit(1))
    formatted = chat_format.format_turns(chat_format.canonical_turns(df, "conv_id"))
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert [(p.role, p.text) for p in back[1].parsed] == [(r or "", t or "") for _, _, r, t in rows[:9]]
    assert len(back[2].parsed) == 2 and len(back) == 3
    for r in formatted.collect():
        learnt = [unescape(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert learnt == back[r.conv_id].learnt == [p.text for p in back[r.conv_id].parsed if p.role == "assistant"]
    got = {r.conv_id: r for r in chat_format.digest(chat_format.read_back(formatted)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:9]).encode()).hexdigest()
    assert chat_format.digest(chat_format.read_back(chat_format.format_turns(chat_format.canonical_turns(df.limit(0), "conv_id")))).count() == 0


def test_layouts(spark):
    frames = {
        "prompt": spark.createDataFrame([(1, "q", "a")], "id long, prompt string, completion string"),
        "question": spark.createDataFrame([(1, "q", "a")], "id long, question string, answer string"),
        "instruction": spark.createDataFrame([(1, "q", "", "a")], "id long, instruction string, input string, output string"),
        "messages": spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "id long, messages array<struct<role:string,content:string>>"),
        "from_value": spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from:string,value:string>>"),
    }
    for name, df in frames.items():
        df = df.withColumn("extra", F.struct(F.lit(1).alias("role")))
        assert chat_format.select_mapping(df.schema).name == name
        assert [tuple(t) for t in chat_format.canonical_turns(df, "id").first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat_format.select_mapping(spark.range(1).schema)
    no_input = spark.createDataFrame([(1, "q", "a")], "id long, instruction string, output string")
    assert [tuple(t) for t in chat_format.canonical_turns(no_input, "id").first().turns] == [("user", "q"), ("assistant", "a")]
    both = no_input.withColumn("prompt", F.lit("p")).withColumn("completion", F.lit("c")).withColumn("input", F.lit("i"))
    assert chat_format.select_mapping(both.schema).name == "instruction" and chat_format.select_mapping(both.drop("output").schema).name == "prompt"


def test_mixed_records(spark):
    payloads = [{"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "input": "i", "output": "a"}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, {"other": 1},
        {"prompt": "q", "completion": "a", "id": 3}, {"messages": [], "n": {"x": 1}}, {"instruction": "q", "output": 7}, {"conversations": [{"from": "human", "value": "q", "weight": 0.5}, {"value": ["a"], "from": "x"}], "prompt": None}, {"messages": ["a"]}, ["messages"]]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(19, "not json"), (20, None)], "id long, payload string")
    got = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in chat_format.canonical_records(df, "id", "payload").collect()}
    assert got[0] == got[1] == got[3] == [("user", "q"), ("assistant", "a")]
    assert got[2] == [("user", "q\n\ni"), ("assistant", "a")] and got[4] == [("user", "q"), ("assistant", "")]
    assert got[5] is got[10] is got[11] is got[19] is got[20] is None
    assert got[6] == [("user", "q"), ("assistant", "a")] and got[7] == [] and got[8] == [("user", "q"), ("assistant", "7")] and got[9] == [("user", "q"), ("x", '["a"]')]


def named(doc_id, text):
    """What a document's draw is hashed by."""
    return f"text:{hashlib.md5((text or '').encode()).hexdigest()}" if doc_id is None else doc_id


def poisson(u, mean):
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < 400:
        k += 1
        p *= mean / k
        c += p
    return k


def test_poisson_counts(spark):
    docs = [(i, f"s{i % 3}" if i % 7 else None, "word " * (1 + i % 5), 0.5) for i in range(900)] + [(None, "s0", None, 0.1), (1, "s1", "word", 0.1), (5000, "empty", "", 0.2)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, rate double")
    rates = {r._source: (r.rate, r.parts) for r in poisson_mix.source_rates(df, epochs=3.0).collect()}
    sizes = {}
    for _, s, t, _ in docs:
        sizes[s] = sizes.get(s, 0) + len(t or "")
    weights = sum(math.sqrt(x) for x in sizes.values())
    for s, x in sizes.items():
        assert rates[s][0] == pytest.approx(3 * sum(sizes.values()) * math.sqrt(x) / weights / x if x else 0)
    mixed = poisson_mix.mix(df, epochs=3.0)
    got = {}
    for r in mixed.collect():
        got.setdefault((r.doc_id, r.source), []).append((r.copy_no, r.n_copies))
    for d, s, t, _ in docs:
        rate, parts = rates[s]
        want = sum(poisson(int(hashlib.md5(f"17:{j}:{named(d, t)}".encode()).hexdigest()[:13], 16) / 2**52, rate / parts) for j in range(parts))
        assert len(got.get((d, s), [])) == want * sum(1 for x in docs if x[:2] == (d, s))
    assert abs(sum(map(len, got.values())) / sum(rates[s][0] for _, s, _, _ in docs) - 1) < 0.1
    keys = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert len(set(keys)) >= 0.99 * len(keys) and poisson_mix.mix(df.limit(0)).count() == 0


def test_mixing_keeps_columns_and_tells_null_ids_apart(spark):
    rows = [(None, "s", f"text {i}", i) for i in range(300)] + [(7, "s", "a", 300), (7, "s", "b", 301)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, parts int")
    for name in ("cdf", "_row", "group", "key", "tie", "_tie", "_source", "c0", "rate"):
        df = df.withColumn(name, F.lit("mine"))
    mixed = poisson_mix.mix(df, epochs=2.0)
    assert mixed.columns == [c for c in df.columns if c != "rate"] + list(poisson_mix.ADDED)
    got = mixed.collect()
    assert all(r.cdf == r._tie == r.group == r._source == "mine" for r in got)
    copies = {r.parts: r.n_copies for r in got}
    assert len(set(copies.values())) > 2 and copies.get(300) == copies.get(301) and len({r.shuffle_key for r in got if r.doc_id is None}) == sum(r.doc_id is None for r in got)


def test_quality_rules_with_clashing_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: (r.n_words, r.kept) for r in adaptive_quality.judge(df).collect()}
    for name in ("low", "high", "_words", "_lines", "lang_key", "source_key", "group", "_row", "c1", "body", "n_words", "kept"):
        df = df.withColumn(name, F.lit("mine"))
    judged = adaptive_quality.judge(df)
    assert judged.columns == [c for c in df.columns if c not in ("n_words", "kept")] + [*adaptive_quality.COUNTS, "base_failed", "kept"]
    got = judged.collect()
    assert {r.doc_id: (r.n_words, r.kept) for r in got} == want and all(r.low == r.lang_key == r._words == "mine" for r in got)


def test_large_rates_are_split(spark):
    rated = spark.createDataFrame([("a", 100.0), ("b", 0.0), ("c", 0.5)], "_source string, rate double")
    rates = {r._source: r for r in poisson_mix.with_distribution(rated).collect()}
    assert rates["a"].parts == 4 and rates["b"].cdf == [1.0]
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    n = poisson_mix.replicate(docs, poisson_mix.with_distribution(rated)).count()
    assert abs(n / 200_000 - 1) < 0.01


def test_cascade_is_exact(spark):
    keys = [f"h{i}.example/{i * 7919 % 300}" for i in range(1500)]
    listed = set(keys[::9])
    universe = bloom_cascade.universe_of(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(k,) for k in listed] * 2, "key string"))
    levels = bloom_cascade.build_cascade(universe)
    assert len(levels) > 1
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: r.hit for r in bloom_cascade.with_membership(df, [levels], "key", "hit").collect()}
    assert got == {k: k in listed for k in keys}
    sharded = bloom_cascade.build_cascades(universe, max_bytes=250)
    assert len(sharded) > 2
    assert {r.key: r.hit for r in bloom_cascade.with_membership(df, sharded, "key", "hit").collect()} == got


def test_cascades_stay_within_their_bound_as_the_universe_grows(spark):
    sizes = []
    for n in (20_000, 200_000):
        keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
        universe = bloom_cascade.materialize(bloom_cascade.universe_of(keys, keys.limit(0).unionAll(spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string"))))), "u")
        levels = bloom_cascade.build_cascade(universe)
        sizes.append(sum(x.words.nbytes for x in levels))
        assert sizes[-1] <= 1.3 * bloom_cascade.cascade_bytes(300, n - 300) and len(levels[1].words) * 64 < 2 * 300
        assert all(sum(x.words.nbytes for x in c) <= 4096 for c in bloom_cascade.build_cascades(universe, max_bytes=400))
        hits = bloom_cascade.with_membership(keys, [levels], "key", "hit").where("hit")
        assert hits.count() == 300
    assert sizes[1] < 1.4 * sizes[0]
    with pytest.raises(ValueError):
        bloom_cascade.build_cascade(universe, max_bytes=100)


def test_urls(spark):
    urls = ["http://NET/x", "https://a.b.net/x?y", "https://Example.net/en/1#t", "https://m.example.net/de", "http://example.com/de/", "http://example.com/den", "http://xexample.com/de/q", "ftp://org/fr/?", "http://a.org", "no scheme net/", None, "", "http://net", "://net/", "http://q.io/a", "http://q.io/a?b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.page_id: r for r in bloom_cascade.filter_urls(df).collect()}

    def plain(url):
        if not url or "://" not in url:
            return "", "", None
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, v) for h, p, v in bloom_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=lambda x: len(x[0]), default=None)

    for i, url in enumerate(urls):
        host, path, rule = plain(url)
        listed = (host + path) != "" and sum(plain(u)[0] + plain(u)[1] == host + path for u in urls) > 1
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0])
        assert got[i].verdict == (rule[1] if rule else "block" if listed else "allow")
    assert bloom_cascade.filter_urls(df.limit(0)).count() == 0


def test_sketch_quantiles(spark):
    values = [(i * i) % 5003 for i in range(3000)]
    df = spark.createDataFrame([(0, "l", "s", v) for v in values], "measure int, lk string, sk string, v long")
    cut = df.select(F.lit(0).alias("level"), "lk", "sk", "measure", adaptive_quality.bucket(F.col("v")).alias("bucket")).groupBy("level", "lk", "sk", "measure", "bucket").agg(F.count("*").alias("n"))
    r = adaptive_quality.quartiles(cut).first()
    for got, want in ((r.q1[0], sorted(values)[749]), (r.q3[0], sorted(values)[2249])):
        assert want * (1 - 1 / 32) - 1 <= got <= want


def test_sketches_merge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"))
    own = adaptive_quality.sketches(adaptive_quality.with_counts(docs))
    total = own.agg(F.sum("n")).first()[0]
    by_level = {r.level: r.n for r in adaptive_quality.merged(own).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert by_level == {0: total, 1: total, 2: total}
    judged = adaptive_quality.judge(docs, columns=["doc_id"])
    assert judged.count() == docs.count() and judged.where("kept").count() > 0.6 * docs.count()


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    scores, sizes = rng.normal(size=(2, 4, 3)), np.array([4, 2])
    start, trans = rng.normal(size=3), rng.normal(size=(3, 3))
    gamma, expected = crf_lang.forward_backward(scores, sizes, start, trans, pairs=True)
    pairs = np.zeros((3, 3))
    for s, n in enumerate(sizes):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weight = np.array([math.exp(start[p[0]] + sum(scores[s, t, x] for t, x in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        weight /= weight.sum()
        for t in range(n):
            for x in range(3):
                assert gamma[s, t, x] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[t] == x))
        for w, p in zip(weight, paths):
            for a, b in itertools.pairwise(p):
                pairs[a, b] += w
    assert np.allclose(expected, pairs)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, crf_lang.train(docs, crf_lang.Settings(per_lang=40, rounds=25))


def test_language_held_out(spark, model):
    docs, m = model
    got = crf_lang.predict(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count()
    assert right >= 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_of_switched_text(spark, model):
    docs, m = model
    own = {r.lang: r.text for r in docs.where(crf_lang.held_out() & (F.length("text") > 800)).groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    words = {k: crf_lang.words_of(v)[:60] for k, v in own.items()}
    labelled = crf_lang.Labeller(m).label(" ".join(words["en"] + words["es"] + words["de"]))
    want = ["en"] * 60 + ["es"] * 60 + ["de"] * 60
    assert sum(a == b for (_, a), b in zip(labelled, want)) > 0.9 * len(want)


def test_language_edges(spark, model):
    _, m = model
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "the of and"), (1, "the of and"), (5, "é" * 5000)], "doc_id long, text string").withColumn("held_out", F.lit("x")).withColumn("lang", F.lit("zz"))
    got = crf_lang.predict(df, m).collect()
    assert sorted((r.lang_pred, r.score) for r in got if r.lang_pred == "und") == [("und", 0.0)] * 3 and len(got) == 6
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert {r.lang_pred for r in crf_lang.predict(df, None).collect()} == {"und"}
    assert crf_lang.train(df.limit(0)) is None and crf_lang.predict(df.limit(0), m).count() == 0
    assert crf_lang.keep_certain(df, m, 0.4).count() <= 3
    assert {r.doc_id for r in crf_lang.keep_certain(df, None, 0.4).collect()} == {None, 1, 5}


def test_predictions_by_a_plain_chain(spark, model):
    """lang_pred and score against forward-backward in plain Python, word by word."""
    _, m = model
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, "the of and " * 700), (901, "é" * 200 + " und der"), (902, None)]
    got = {r.doc_id: r for r in crf_lang.predict(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    start, trans = np.exp(m.start.astype(float)), np.exp(m.trans.astype(float))

    def plain(text):
        words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        words = [w[k : k + 64] for w in words for k in range(0, len(w), 64)]
        total = np.zeros(len(m.langs))
        for c in range(0, len(words), crf_lang.CHAIN):
            chain = words[c : c + crf_lang.CHAIN]
            e = [np.exp(s - s.max()) for s in (m.weights[crf_lang.features(w, m.lexicon, len(m.weights))].astype(float).sum(axis=0) for w in chain)]
            ahead, back = [start * e[0]], [np.ones(len(m.langs))]
            for x in e[1:]:
                ahead.append((ahead[-1] / ahead[-1].sum()) @ trans * x)
            for x in reversed(e[1:]):
                b = trans @ (x * back[-1])
                back.append(b / b.sum())
            for w, a, b in zip(chain, ahead, reversed(back)):
                total += len(w) * a * b / (a * b).sum()
        return ("und", 0.0) if not words else (m.langs[int(total.argmax())], total.max() / total.sum())

    for d, text in rows:
        lang, score = plain(text)
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(score, abs=1e-3)


def test_every_language_is_learned(spark):
    """A language of long texts only, and more languages than the sample has documents for."""
    long = [(i, "hola casa perro gato " * 8000, "es") for i in range(6)] + [(100 + i, "the house and the dog", "en") for i in range(200)]
    df = spark.createDataFrame(long, "doc_id long, text string, lang string")
    sample = crf_lang.training_sample(df, crf_lang.Settings(per_lang=20))
    assert {x for _, x in sample} == {"es", "en"} and all(len(t) <= 20_000 for t, _ in sample) and sum(x == "en" for _, x in sample) == 20
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word of "), F.col("id").cast("string")).alias("text"), (F.col("id") % 300).cast("string").alias("lang"))
    sample = crf_lang.training_sample(many, crf_lang.Settings(most_docs=600))
    assert len({x for _, x in sample}) == 300 and len(sample) <= 600


def test_minibatches_give_the_full_gradient(spark):
    sample = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and length(text) between 100 and 900").orderBy("doc_id").limit(24).collect()]
    one, many = (crf_lang.fit(sample, crf_lang.Settings(batch=b, rounds=3)) for b in (10_000, 7))
    assert np.allclose(one.weights, many.weights, atol=2e-3) and np.allclose(one.trans, many.trans, atol=2e-3)
