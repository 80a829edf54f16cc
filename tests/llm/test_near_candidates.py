"""The search for near copies goes by SimHash and BK-trees: against plain bits and the distance of every pair."""

from __future__ import annotations

import itertools
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_near_copies import copies, plain_groups

from quire.llm import near_copies


def joined(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_a_bit_is_set_by_over_half_of_the_hashes():
    for n in (1, 2, 7, 255, 256, 1000):
        found = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        got = near_copies.simhash(found, 3)
        for w in range(3):
            hashed = near_copies.mixed(found * near_copies.FACTORS[w] + near_copies.OFFSETS[w]).tolist()
            assert int(got[w]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > n)


@pytest.mark.parametrize("two", [False, True])
def test_trees_find_what_is_near(two):
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 63, (60, 2)).astype(np.uint64)
    for k in range(10, 60):
        flips = np.zeros(128, np.uint8)
        flips[rng.choice(128, int(rng.integers(0, 45)), replace=False)] = 1
        fps[k] = fps[k % 10] ^ np.packbits(flips).view(np.uint64)
    fps[20], fps[33] = fps[5], fps[5]
    part = rng.integers(0, 2, 60) if two else np.zeros(60, int)
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    want = [(i, j) for i, j in itertools.combinations(range(60), 2) if far[i, j] <= near_copies.RADIUS]
    found = near_copies.near_fingerprints(fps, part)
    assert {(min(e), max(e)) for e in found} <= set(want)
    if two:  # pairs of one part are that part's own unit's
        for p in (0, 1):
            at = np.flatnonzero(part == p)
            found += [(int(at[x]), int(at[y])) for x, y in near_copies.near_fingerprints(fps[at], part[at])]
    assert joined(60, found) == joined(60, want)


@pytest.mark.parametrize("tree_size", [2048, 16])
def test_candidates_hold_every_link(spark, tree_size):
    texts = copies(8)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "tie long, text string")
    sketched = near_copies.sketches(rows, *near_copies.tables(len(texts)))
    edges = [(r.a, r.b) for r in near_copies.candidates(sketched, tree_size).collect()]
    words = [near_copies.simhash(near_copies.shingles(t), near_copies.WORDS) for t in texts]
    assert all(int(np.bitwise_count(words[a] ^ words[b]).sum()) <= near_copies.RADIUS for a, b in edges)
    own, linked = joined(len(texts), edges), plain_groups(texts)
    assert all(own[k] == own[linked[k]] for k in range(len(texts)))


def test_tables_grow_with_the_texts():
    assert [near_copies.tables(n) for n in (0, 1000, 256_000)] == [(1, 4), (2, 6), (10, 35)]
    assert all((1 - near_copies.AGREE**bits) ** number <= near_copies.MISSED for bits, number in map(near_copies.tables, (1, 10**4, 10**6, 10**9)))


def one_group(n=240, seed=4):
    """Near copies of one text, each with a word or two changed, and texts half of which is the same."""
    rng = np.random.default_rng(seed)
    words, out = [f"w{k}" for k in range(120)], []
    for k in range(n):
        own = list(words)
        for at in rng.integers(0, 120, 1 + k % 2):
            own[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(own))
    return out + [" ".join(words[:60] + [f"y{k}_{i}" for i in range(60)]) for k in range(10)]


@pytest.mark.parametrize("tree_size", [2048, 8])
def test_edges_of_a_large_group_grow_with_its_texts(spark, tree_size):
    texts = one_group()
    rows = spark.createDataFrame(list(enumerate(texts)), "tie long, text string")
    edges, labels = near_copies.searched(near_copies.sketches(rows, 4, 24), tree_size)
    assert len(edges.collect()) <= (near_copies.FIRST + 1) * len(texts)
    assert joined(len(texts), [tuple(r)[:2] for r in edges.collect()]) == joined(len(texts), [tuple(r) for r in labels.collect()])


def test_links_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    texts, counts, plain = one_group(), [], near_copies.components
    rows = spark.createDataFrame(list(enumerate(texts)), "tie long, text string")
    pool = spark.createDataFrame([(k, 0) for k in range(len(texts))], "node long, label long")
    monkeypatch.setattr(near_copies, "components", lambda edges: counts.append(edges.count()) or plain(edges))
    label = {r.node: r.label for r in near_copies.link_groups(rows, pool, pool_size=10).collect()}
    want = plain_groups(texts)
    assert all((label.get(i, i) == label.get(j, j)) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(texts)), 2))
    assert sum(counts) <= 2 * len(texts)
