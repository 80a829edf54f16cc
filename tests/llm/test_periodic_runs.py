"""Periodic runs against a search of every lag."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quire.llm import periodic_runs
from quire.llm.queries import QUERIES


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            run = w[i : j + q]
            if len(run) >= max(24, 3 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i, len(run), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, altered=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if altered and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    kept = [True] * n
    for s, length, q in runs:
        kept[s + q : s + length] = [False] * (length - q)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for x, k in zip(w, kept) if k)))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(150):
        docs = []
        for _ in range(5):
            n, few = rng.choice([0, 5, 23, 24, 30, 60, 200, 400]), rng.choice([1, 2, 3, 5, 50])
            w = [str(rng.randrange(few)) for _ in range(n)]
            for _ in range(rng.randrange(4) if n > 30 else 0):
                s, p = rng.randrange(n), rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 20, 31, 32, 33, 40])
                for i in range(s + p, min(n, s + p * rng.choice([2, 3, 4, 6]) + rng.randrange(p))):
                    w[i] = w[i - p]
            docs.append(w)
        found = periodic_runs.search([" ".join(w).encode() for w in docs])
        assert [runs for _, runs, _ in found] == [plain_runs(w) for w in docs]


def test_exactly_three_periods_and_the_shortest_run():
    other = [f"x{i}" for i in range(40)]
    for q in (1, 5, 8, 9, 16, 17, 33):
        least = max(24, 3 * q)
        for length in (least - 1, least):
            w = other + [f"w{i % q}" for i in range(length)] + ["end"]
            runs = periodic_runs.search([" ".join(w).encode()])[0][1]
            assert runs == ([(40, length, q)] if length == least else []), (q, length)


def test_very_long_texts_in_pieces():
    text = ("ab " * 400_000).encode() + b"tail of it"
    (n, runs, collapsed), (m, others, rest) = periodic_runs.search([text, b" ".join(b"w%d" % i for i in range(300_000))])
    assert (n, runs, collapsed) == (400_003, [(0, 400_000, 1)], b"ab tail of it") and (m, others) == (300_000, [])
    words = [w for part in periodic_runs.pieces(text, 1000) for w in part]
    assert words == text.split() and len(rest.split()) == 300_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (5, "a b " * 12), (5, "a b " * 12), (6, "x\x1cy\xa0z " * 24), (9, "été ß 日本 " * 9), (7, "one two"), (20, "\n".join("pqrst"[i % 5] for i in range(200)))]
    return spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, runs int, `a.text` string").toDF("doc_id", "text", "Text", "a.text")


def test_odd_rows(odd, spark):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in periodic_runs.digests(periodic_runs.periodic_runs(odd)).collect()]
    assert sorted(got, key=key) == sorted((plain_row(r.doc_id, r.text, altered=False) for r in odd.collect()), key=key)
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


def test_query_against_every_lag(spark):
    where = "/root/testdata/sf0.001"
    want = [plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, where).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0]) and sum(r[1] for r in want) > 10
