"""A run as a stream that is stopped and goes on, against the batch operators on the finished run."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quire.operators import job as J
from quire.operators import merge as M
from quire.sources import tables as T
from quire.streaming import run as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def answers(spark):
    return T.conversation_answers(spark, SF).withColumn("lapse", F.when(F.col("text").isNull() & F.col("lapse").isNull(), "failed").otherwise(F.col("lapse"))).persist()


def arriving(spark, folder):
    return spark.readStream.schema("page long, index int, text string, lapse string").parquet(str(folder))


def test_stopped_and_gone_on(spark, answers, tmp_path):
    plan = J.section_counts(answers).select("page", F.col("sections").cast("int").alias("total"))
    arrived, run = tmp_path / "arrived", f"file://{tmp_path}/run"
    parts = [answers.where("index in (0, 3)"), answers.where("index = 2 or index = 0"), answers.where("index not in (0, 2, 3)")]  # out of order, and some twice
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(arrived))
        R.run_available(spark, R.follow(arriving(spark, arrived), plan), run)
        sofar = parts[0] if not k else sofar.union(part).dropDuplicates(["page", "index"])
        got = {r.page: r for r in R.latest(spark, run).collect()}
        known = answers.join(sofar.select("page", "index", F.lit(True).alias("came")), ["page", "index"], "left")
        known = known.select("page", "index", *(F.when(F.col("came"), F.col(c)).alias(c) for c in ("text", "lapse")))
        asked = {r.page: (r["index"], r.prompt) for r in J.next_steps(known).collect()}
        done = {r.page: r.done for r in J.progress(known).collect()}
        merged = {r.page: r.text for r in M.merge_pages(known).collect()}
        assert got and all((r["index"], r.prompt) == asked.get(p, (None, None)) for p, r in got.items())
        assert all(r.done == done[p] and r.text == merged.get(p, "") for p, r in got.items())
    assert len(got) == plan.count() and not asked
    lapses = {r.page: (r.failed, r.truncated) for r in J.lapse_summary(answers).collect()}
    assert {p: (r.failed, r.truncated) for p, r in got.items()} == lapses


def test_a_section_that_nothing_comes_for_lapses(spark, tmp_path):
    plan = spark.createDataFrame([(1, 3), (2, 1)], "page long, total int")
    rows = [(1, 0, "first line here\nsecond line here", None), (1, 2, "third line here", None), (2, 0, None, "failed")]
    spark.createDataFrame(rows, "page long, index int, text string, lapse string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/run"
    with R.state_store(spark):
        query = R.follow(arriving(spark, tmp_path / "in"), plan, patience_ms=500).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{out}/out/batch={b}")).start()
        try:
            for _ in range(60):
                time.sleep(1)
                got = {r.page: r for r in R.latest(spark, out).collect()} if (tmp_path / "run/out").exists() else {}
                if got.get(1) and got[1]["index"] is None:
                    break
        finally:
            query.stop()
    assert (got[1].done, got[1].failed, got[1].text) == (3, 1, "first line here\nsecond line here\n\nthird line here") and got[2].failed == 1
