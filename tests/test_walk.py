"""Walks of deep and odd trees."""

from __future__ import annotations

import random

from quire.operators import library as LB

SCHEMA = "id string, parent string, name string, kind string, file_type string"


def rows_of(df):
    return sorted((r.id, r.depth, r.path) for r in df.collect())


def test_a_chain_of_two_thousand_folders(spark, monkeypatch):
    chain = [(f"f{k}", f"f{k - 1}" if k else "", f"n{k}", "folder", "") for k in range(2000)] + [("leaf", "f1999", "leaf", "document", "pdf")]
    written, tables = LB.written, []
    monkeypatch.setattr(LB, "written", lambda df, path: tables.append(path) or written(df, path))
    got = {r.id: (r.depth, r.path) for r in LB.walk(spark.createDataFrame(chain, SCHEMA)).collect()}
    assert len(got) == 2001 and got["leaf"] == (2000, "/".join(f"n{k}" for k in range(2000)) + "/leaf") and got["f0"] == (0, "n0")
    assert sum("reached" in t for t in tables) <= 15 and sum("far-paths" in t for t in tables) <= 15


def test_random_trees_with_cycles_and_lost_parents(spark):
    rng = random.Random(2)
    rows = [(f"f{k}", rng.choice(["", "trash", "gone", *(f"f{j}" for j in range(max(0, k - 2), k))]), f"n{k}", "folder", "") for k in range(60)]
    rows += [(f"g{k}", f"g{k - 1}" if k else "", f"m{k}", "folder", "") for k in range(40)]
    rows += [("a", "b", "a", "folder", ""), ("b", "a", "b", "folder", ""), ("s", "s", "s", "folder", "")]
    rows += [(f"d{k}", rng.choice(["", "trash", "a", "s", *(f"f{j}" for j in range(60))]), f"d{k}", "document", "pdf") for k in range(200)] + [("d1", "", "again", "document", ""), ("n", None, "n", "folder", "")]
    items = spark.createDataFrame(rows, SCHEMA)
    want = rows_of(LB.walk_by_level(items))
    assert rows_of(LB.walk(items)) == want and len(want) > 50


def test_repeated_ids_of_folders(spark):
    rows = [("f", "", "first", "folder", ""), ("f", "g", "again", "folder", ""), ("g", "f", "inner", "folder", ""), ("d", "g", "doc", "document", "")]
    items = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(LB.walk(items)) == rows_of(LB.walk_by_level(items)) == [("d", 2, "first/inner/doc"), ("f", 0, "first"), ("f", 2, "first/inner/again"), ("g", 1, "first/inner")]
    assert LB.walk(items.limit(0)).count() == 0
