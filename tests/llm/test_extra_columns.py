"""Extra columns that look like another layout, or that differ from an added column in case only."""

from __future__ import annotations

from quire.llm import chat_format, poisson_mix


def test_rows_win_over_a_layout_of_as_many_paths(spark):
    rows = [(1, 0, "user", "hello", "a", "b", "c"), (1, 1, "assistant", "hi", "a", "b", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, instruction string, input string, output string")
    got = chat_format.canonical_turns(df, "conv_id").collect()
    assert [(r.conv_id, [tuple(t) for t in r.turns]) for r in got] == [(1, [("user", "hello"), ("assistant", "hi")])]
    named = next(m for m in chat_format.MAPPINGS if m.name == "instruction")
    assert {tuple(tuple(t) for t in r.turns) for r in chat_format.canonical_turns(df, "conv_id", mapping=named).collect()} == {(("user", "a\n\nb"), ("assistant", "c"))}


def test_mixed_documents_have_one_rate(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "s", 0.5, 1) for k in range(40)], "doc_id long, text string, source string, Rate double, `a.b` int")
    mixed = poisson_mix.mix(docs)
    assert mixed.columns.count("rate") == 1 and "Rate" not in mixed.columns and "a.b" in mixed.columns
    assert mixed.select("rate").distinct().count() == 1
