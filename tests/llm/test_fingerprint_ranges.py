"""Ranges of fingerprints under many null and repeated ids: sizes, and the order across them."""

from __future__ import annotations

from quire.llm import poly_hash


def order(row):
    return row[0] is not None, row[0] or 0, row[1]


def given(spark):
    text = lambda k: f"{k * 7919 % 4001} words of text {k} " * 5
    rows = [(None if k % 2 else 7 if k % 4 else (1 << 60) + k, text(k)) for k in range(4000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_null_and_repeated_ids_are_divided(spark):
    rows, docs = given(spark)
    sized = poly_hash.with_next(docs, spread=12).where("not guest").groupBy("part").count().collect()
    assert len(sized) > 20 and sum(r["count"] for r in sized) == 4000
    assert max(r["count"] for r in sized) <= 2 * 4000 / len(sized)


def test_order_holds_across_ranges(spark):
    rows, docs = given(spark)
    parts = {}
    for r in poly_hash.with_next(docs, spread=12).collect():
        parts.setdefault(r.part, []).append(r)
    rows.sort(key=order)
    after = {}
    for part in parts.values():
        part.sort(key=lambda r: (r.guest, *order((r.doc_id, r.text))))
        assert sum(r.guest for r in part) == 1
        after |= {(a.doc_id, a.text): (b.doc_id, b.text) for a, b in zip(part, part[1:])}
    assert after == dict(zip(rows, rows[1:] + rows[:1]))


def test_equal_rows(spark):
    docs = spark.createDataFrame([(None, "same text")] * 50 + [(1, "same text")] * 50, "doc_id long, text string")
    found = poly_hash.fingerprints(docs, spread=1).collect()
    assert len(found) == 100 and all(r.near_next == 1.0 for r in found)
