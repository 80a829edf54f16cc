"""No language is lost from the training sample."""

from __future__ import annotations

import pytest

from quire.llm import crf_lang


@pytest.mark.parametrize("text", ["uno dos tres", "einmal mehr", "ka pa ta", "x", "été là", "slovo za slovom"])
def test_a_language_of_equal_rows(spark, text):
    rows = [(None, text, "aa")] * 1000 + [(d, f"some words of number {d}", "en") for d in range(400)]
    sample = crf_lang.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert [t for t, lang in sample if lang == "aa"] == [text]
    assert len([t for t, lang in sample if lang == "en"]) == 150


def test_a_long_text_with_letters_at_its_edges(spark):
    long = "primera palabra " + "1 " * 60_000 + "fin"
    rows = [(1, long, "aa"), (4, "9 " * 60_000 + "solo al final", "bb"), (5, "plain words", "en"), (8, "1 2 3", "cc"), (9, None, "dd")]
    docs = spark.createDataFrame([(None, t, x) for _, t, x in rows], "doc_id long, text string, lang string")
    got = dict((lang, t) for t, lang in crf_lang.training_sample(docs))
    assert set(got) == {"aa", "bb", "en"} and got["bb"] == "solo al final" and got["aa"].startswith("primera palabra")


def test_language_ties_go_to_the_first(spark):
    model = crf_lang.fit([("same words here", "bb"), ("same words here", "aa")], crf_lang.Settings(rounds=0))
    docs = spark.createDataFrame([(1, "same words here")], "doc_id long, text string")
    assert model.langs == ["aa", "bb"] and crf_lang.predict(docs, model).first().lang_pred == "aa"
