"""The supplied tables, and the relations that stand for scanned pages and raw answers.

The supplied texts hold no fences, footers or bullets, so these are derived from every document by fixed rules on its
doc_id and on line numbers; the same rules are in the SQL of the catalogue.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import text as X

#: Width of the pages that documents stand for: one line is one row of pixels.
PAGE_WIDTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_relation(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """(doc_id, row, line), rows from 0."""
    return docs.select("doc_id", F.posexplode(X.lines(text)).alias("row", "line"))


def raw_answers(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, raw): each document as a model would wrap it, in one of six ways; with ``more``, those columns too."""
    t, word = X.text_of("text"), lambda k: F.split_part(X.text_of("text"), F.lit(" "), F.lit(k))
    k = F.pmod("doc_id", F.lit(6))
    raw = (
        F.when(k == 0, F.concat(F.lit("```markdown\n"), t, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("    "), F.replace(t, F.lit("\n"), F.lit("\n    "))))
        .when(k == 2, F.replace(t, F.lit(" "), F.lit("   ")))
        .when(k == 3, F.concat(t, F.lit(f"\n{X.FOOTER_MARKER}\n- "), word(1), F.lit("\n* none\n• "), word(2)))
        .when(k == 4, F.concat(F.lit("```\n"), t))
        .otherwise(F.concat(F.lit("\n\n"), t, F.lit("\n\n\n\n"), t))
    )
    return docs.select("doc_id", *more, raw.alias("raw"))


def marked_up(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line): lines turned into bullets, rules and numbered items by their number."""
    k = (F.col("row") + F.col("doc_id")) % 11
    line = (
        F.when(k == 0, F.concat(F.lit("- "), F.col("line")))
        .when(k == 1, F.lit("---"))
        .when(k == 2, F.concat(F.lit("* "), F.col("line")))
        .when((k == 3) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("   - "), F.col("line")))
        .when(k == 4, F.concat(F.lit("1. "), F.col("line")))
        .when((k == 5) & (F.col("doc_id") % 5 == 0), F.lit("same again"))
        .when((k == 6) & (F.col("doc_id") % 5 == 0), F.lit(" same again"))
        .otherwise(F.col("line"))
    )
    return line_relation(docs).select("doc_id", "row", line.alias("line"))


def marked_up_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``marked_up`` for every document, also those without lines, in one row-local pass."""
    def line(x: Column, i: Column) -> Column:
        k, d = (i + F.col("doc_id")) % 11, F.col("doc_id")
        return (
            F.when(k == 0, F.concat(F.lit("- "), x)).when(k == 1, F.lit("---")).when(k == 2, F.concat(F.lit("* "), x))
            .when((k == 3) & (d % 3 == 0), F.concat(F.lit("   - "), x)).when(k == 4, F.concat(F.lit("1. "), x))
            .when((k == 5) & (d % 5 == 0), F.lit("same again")).when((k == 6) & (d % 5 == 0), F.lit(" same again")).otherwise(x)
        )

    opener = F.when(F.col("doc_id") % 7 == 0, F.lit("Here is the page:\n")).when(F.col("doc_id") % 7 == 1, F.lit("```\n")).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat(opener, F.array_join(F.transform(X.lines("text"), line), "\n")).alias("text"))


def row_profile(docs: DataFrame) -> DataFrame:
    """(doc_id, row, brightness): short lines are bright rows."""
    return line_relation(docs).select("doc_id", "row", (255 - F.least(F.lit(255), F.length("line"))).alias("brightness"))


def answers_of(turns: DataFrame) -> DataFrame:
    """(page, index, text, lapse): a conversation is a page and a turn a section; turns of a system lapsed."""
    lapse = F.when(F.col("role") == "system", F.lit("failed")).when(F.length("text") > 300, F.lit("truncated"))
    return turns.select(F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("index"), F.when(F.col("role") != "system", F.col("text")).alias("text"), lapse.alias("lapse"))


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers_of(table(spark, sf_dir, "conversations"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves a local master
    only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it is computed once and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def layout_of_lines() -> tuple[Column, Column, L.Layout]:
    """(ceiling, least gap, layout) of the pages that documents stand for."""
    width = F.lit(PAGE_WIDTH)
    return L.max_section_height(width), L.min_gap(width), L.Layout()
