"""The prefix trie against nested dictionaries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from quire.llm import prefix_trie
from quire.llm.queries import QUERIES


def plain_trie(rows, rebuilt):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + ts[h:] if rebuilt else ts
    members, kids = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
    ends = lambda node: hashlib.sha256(",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node)))).encode()).hexdigest()
    return sorted(
        (min(cs), len(v), min(members[v[:-1]]) if v else None, len(cs), len(kids[v]), leaves[v], saved[v], ends(v)) for v, cs in members.items()
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


ODD = [(5 * i + j, t, "user" if t % 2 else "assistant", f"turn {t} of {i % 3}" if t < 4 else f"own {i}-{j}-{t}") for i in range(12) for j in range(5) for t in range(2 + (i + j) % 11)]
ODD += [(900, None, "user", "null turn"), (900, None, "user", "null turn"), (900, 1, None, None), (900, 1, "", "é"), (900, 1, "user", "tie b"), (900, 1, "user", "tie a")]
ODD += [(-7, 1, "user", "negative"), (-7, 2, "assistant", "x" * 5000), (None, 1, "user", "no conversation"), (None, None, None, None), (904, 3, "user", "borrows all"), (10**12 + 3, 1, "a", "base is absent")]
ODD += [(2000 + k, t, "user", f"copy {t}") for k in range(60) for t in range(12)]
ODD += [(3000, t, "user", f"long {t % 7}") for t in range(300)] + [(3001, t, "user", f"long {t % 7}") for t in range(200)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, 1, "clash", "x") for r in ODD], "conv_id long, turn long, role string, text string, p1 int, depth string, x string")
    return df.toDF("conv_id", "turn", "role", "text", "p1", "depth", "Text").repartition(5).persist()


@pytest.mark.parametrize(("rebuilt", "most"), [(True, prefix_trie.MOST), (False, 8)])
def test_odd_rows(spark, odd, rebuilt, most):
    """A sketch of any size gives the same trie; conversations cut by partitions are whole."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("false", "12")):
        spark.conf.set(k, v)
    try:
        got = rows_of(prefix_trie.prefix_trie(odd, rebuilt, most))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == plain_trie(ODD, rebuilt)


def test_tails_are_proven_and_stay(spark, odd):
    rows = prefix_trie.screen(prefix_trie.prefixes(*prefix_trie.numbered_turns(odd.where("conv_id < 1000"))))
    kinds = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    alone = sum(1 for r in plain_trie([r for r in ODD if r[0] is not None and r[0] < 1000], False) if r[3] == 1)
    assert kinds[1] + kinds[2] > 0.9 * alone and kinds[2] > kinds[1] / 2
    shared = rows.where("kind > 0").join(rows.select("p1", "p2", "conv_id").withColumnRenamed("conv_id", "other"), ["p1", "p2"]).where("other <> conv_id")
    assert shared.count() == 0


def test_no_conversations(spark, odd):
    assert prefix_trie.prefix_trie(odd.limit(0), True).count() == 0
    assert prefix_trie.prefix_trie(odd.where("conv_id is null")).count() == 0


def test_query_against_the_plain_trie(spark):
    where = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, where)) == plain_trie(rows, True)
