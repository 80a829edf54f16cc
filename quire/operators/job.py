"""The state of a run over sections: context, offsets, progress and lapses. Answers are (page, index, text, lapse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import merge as M
from quire.plans import prompts as P


def previous_text(answers: DataFrame) -> DataFrame:
    """Add ``previous``: the answer of the section just above on the same page; null if that one lapsed."""
    return answers.withColumn("previous", F.lag("text").over(Window.partitionBy("page").orderBy("index")))


def section_counts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("page").agg(F.count("*").alias("sections"))


def section_offsets(counts: DataFrame, group: Column) -> DataFrame:
    """(grp, page, sections, offset): sections of the earlier pages of the same document ``group``."""
    before = Window.partitionBy("grp").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("grp", group).withColumn("offset", F.coalesce(F.sum("sections").over(before), F.lit(0)))


def located(offsets: DataFrame) -> DataFrame:
    """(grp, nth, page, within): every ordinal of a document's sections with its page and place."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sections") - 1))
    return offsets.select("grp", "page", "offset", each.alias("within")).select("grp", (F.col("offset") + F.col("within")).alias("nth"), "page", "within")


def progress(answers: DataFrame) -> DataFrame:
    """(page, done, total, fraction, next_index): a lapse counts as done; ``next_index`` is the first section without
    an answer or a lapse."""
    done = F.col("text").isNotNull() | F.col("lapse").isNotNull()
    out = answers.groupBy("page").agg(F.count_if(done).alias("done"), F.count("*").alias("total"), F.min(F.when(~done, F.col("index"))).alias("next_index"))
    return out.withColumn("fraction", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("done") / F.col("total")))


def lapse_summary(answers: DataFrame) -> DataFrame:
    """(page, failed, truncated, lapsed): ``lapsed`` lists the indexes in order."""
    lapsed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lapse").isNotNull(), F.col("index")))), lambda i: i.cast("string")), ",")
    return answers.groupBy("page").agg(F.count_if(F.col("lapse") == "failed").alias("failed"), F.count_if(F.col("lapse") == "truncated").alias("truncated"), lapsed.alias("lapsed"))


def next_steps(answers: DataFrame) -> DataFrame:
    """(page, index, prompt) of each page's first section without an answer or a lapse; no row for a finished page."""
    told = previous_text(answers).withColumn("total", F.count("*").over(Window.partitionBy("page")))
    waiting = told.where(F.col("text").isNull() & F.col("lapse").isNull())
    step = waiting.select("page", "index", P.for_section(F.col("index"), F.col("total"), F.col("previous")).alias("prompt"))
    return step.groupBy("page").agg(F.min_by(F.struct("index", "prompt"), "index").alias("s")).select("page", "s.index", "s.prompt")


def accept(plan: DataFrame, arrived: DataFrame) -> DataFrame:
    """A plan (page, index) with the arrived raw answers (page, index, raw): stored transcribed; those of no planned
    section are ignored."""
    return plan.join(arrived, ["page", "index"], "left").select("page", "index", F.when(F.col("raw").isNotNull(), X.transcribed("raw")).alias("text"))


def accept_lapses(plan: DataFrame, arrived: DataFrame) -> DataFrame:
    """(page, index, text, lapse) of a plan with what arrived (page, index, raw, lapse): a section that lapsed keeps the
    part of an answer that came, transcribed, if any did."""
    joined = plan.join(arrived, ["page", "index"], "left")
    return joined.select("page", "index", F.when(F.col("raw").isNotNull(), X.transcribed("raw")).alias("text"), "lapse")


def merged_pages(answers: DataFrame) -> DataFrame:
    """(page, sections, text): each planned page with its merged answers; empty where none was answered."""
    return section_counts(answers).join(M.merge_pages(answers), "page", "left").withColumn("text", F.coalesce("text", F.lit("")))


def text_so_far(pages: DataFrame, group: Column) -> DataFrame:
    """(grp, text): the pages (page, text) of each document that aren't blank, in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", X.trim(F.col("text")).alias("bare"), "text")))
    texts = F.transform(F.filter(ordered, lambda p: p["bare"] != ""), lambda p: p["text"])
    return pages.groupBy(group.alias("grp")).agg(F.array_join(texts, "\n\n").alias("text"))


def finish(pages: DataFrame, group: Column, model: Column, processed: Column) -> DataFrame:
    """Transcripts (grp, source, model, processed, pages) of merged pages (page, sections, text, source), numbered from 1."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text", "sections")))
    numbered = F.transform(ordered, lambda p, i: F.struct((i + 1).alias("number"), p["text"].alias("text"), p["sections"].cast("int").alias("sections")))
    grouped = pages.groupBy(group.alias("grp")).agg(F.min("source").alias("source"), numbered.alias("pages"))
    return grouped.select("grp", "source", model.alias("model"), processed.alias("processed"), "pages")
