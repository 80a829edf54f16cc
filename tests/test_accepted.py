"""The query of accepted answers against a transcription of every turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans import catalog
from quire.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_accepted_answers_of_every_turn(spark):
    turns = T.conversation_answers(spark, SF).collect()
    answered = [r for r in turns if r.text is not None]
    # One row a text, wrapped by its page and transcribed on its own, in the order of the turns.
    alone = spark.createDataFrame([(r.page, k, r.text) for k, r in enumerate(answered)], "doc_id long, k long, text string")
    texts = {r.k: r.text for r in T.raw_answers(alone, "k").select("k", X.transcribed(F.col("raw")).alias("text")).collect()}
    want = {(r.page, r["index"]): texts[k] for k, r in enumerate(answered)}
    got = [tuple(r) for r in catalog.QUERIES["accepted_answers"](spark, SF).select("page", "index", "text").collect()]
    assert sorted(got, key=str) == sorted(((r.page, r["index"], want.get((r.page, r["index"]))) for r in turns), key=str)
    assert len({i for _, i, t in got if t is not None}) > 1
