"""From a page's brightness profile to overlapping sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions.text import let


def blank_runs(profile: DataFrame, threshold: int, least: Column, key: str = "doc_id") -> DataFrame:
    """(key, start, end): maximal runs of bright rows of at least ``least`` rows, half-open.

    Gaps and islands: within a page, row number minus rank is the same along a run.
    """
    bright = profile.where(F.col("brightness") >= threshold)
    island = F.col("row") - F.row_number().over(Window.partitionBy(key).orderBy("row"))
    runs = bright.withColumn("_island", island).groupBy(key, "_island").agg(F.min("row").alias("start"), (F.max("row") + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= least).select(key, "start", "end")


def pages(profile: DataFrame, threshold: int, least: Column, key: str = "doc_id") -> DataFrame:
    """(key, height, runs): the ascending blank runs of each page in one row, also where there are none.

    One aggregation by page: runs come from the page's ordered bright rows, so a page is shuffled once.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col("brightness") >= threshold, F.col("row"))))
    grouped = profile.groupBy(key).agg(F.count("*").cast("int").alias("height"), rows.alias("_rows"))
    starts = F.filter("_rows", lambda r, i: (i == 0) | (F.get("_rows", i - 1) != r - 1))
    ends = F.filter("_rows", lambda r, i: (i == F.size("_rows") - 1) | (F.get("_rows", i + 1) != r + 1))
    runs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))), lambda r: r["end"] - r["start"] >= least)
    return grouped.select(key, "height", runs.alias("runs"))


def with_sections(paged: DataFrame, ceiling: Column, layout: L.Layout = L.Layout()) -> DataFrame:
    """Add ``cuts`` and ``sections`` to (key, height, runs)."""
    def both(cuts: Column) -> Column:
        return F.struct(cuts.alias("cuts"), L.sections(cuts, F.col("height"), ceiling, layout).alias("sections"))

    return paged.select("*", F.inline(F.array(let(L.cut_points(F.col("runs"), F.col("height"), ceiling, layout), both))))


def section_rows(sectioned: DataFrame, key: str = "doc_id") -> DataFrame:
    return sectioned.select(key, "height", F.inline("sections"))


def coverage_gaps(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, from_row, to_row): rows of a page that lie in none of its sections."""
    by_page = Window.partitionBy(key).orderBy("top", "bottom")
    reached = F.coalesce(F.max("bottom").over(by_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    between = rows.withColumn("_reached", reached).where("top > _reached").select(key, F.col("_reached").alias("from_row"), F.col("top").alias("to_row"))
    after = rows.groupBy(key).agg(F.max("bottom").alias("from_row"), F.max("height").alias("to_row")).where("from_row < to_row")
    return between.unionByName(after)
