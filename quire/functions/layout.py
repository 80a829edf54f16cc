"""Column functions that turn page sizes and blank runs into sections.

Ratios are single-precision values widened to double, as layouts are given that way: 1620 * 1.4 truncates to 2267.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let


@dataclass(frozen=True)
class Layout:
    """Fixed values of the default layout."""

    max_aspect: float = 1.4
    overlap_percent: float = 18.0
    blank_threshold: int = 246
    gap_ratio: float = 1.0 / 72.0
    snap_radius: float = 0.15
    most_sections: int = 64


#: Pixels that one section may carry (fixed value: 3,800 tokens of 32 x 32 pixels).
PIXEL_BUDGET = 3_800 * 32 * 32

SECTION = "struct<top:int,bottom:int,index:int,total:int>"


def single(x: float) -> Column:
    return F.lit(x).cast("float").cast("double")


def max_section_height(width: Column, layout: Layout = Layout()) -> Column:
    return F.greatest((width * single(layout.max_aspect)).cast("int"), F.lit(1))


def min_gap(width: Column, layout: Layout = Layout()) -> Column:
    return F.greatest((width * single(layout.gap_ratio)).cast("int"), F.lit(1))


def section_count(height: Column, ceiling: Column, layout: Layout = Layout()) -> Column:
    """1 if the page fits; else the least n whose middle sections fit; at most ``most_sections``."""
    h, c, o = height.cast("double"), ceiling.cast("double"), F.lit(layout.overlap_percent) / F.lit(100.0)
    fits = F.filter(F.sequence(F.lit(2), F.lit(layout.most_sections)), lambda n: h / n + F.lit(2.0) * (h * o / (n - 1)) <= c)
    return F.when(height <= ceiling, F.lit(1)).otherwise(F.coalesce(F.array_min(fits), F.lit(layout.most_sections)))


def cut_points(runs: Column, height: Column, ceiling: Column, layout: Layout = Layout()) -> Column:
    """Ascending cuts near even intervals, each at the nearest middle of a blank run (``runs``: array of start, end)."""
    h = height.cast("double")
    middles = F.transform(runs, lambda r: (r["start"] + F.floor((r["end"] - r["start"]) / 2)).cast("int"))

    def fold(known: Column) -> Column:
        count = known["n"]

        def snap(cuts: Column, i: Column) -> Column:
            ideal = h * i / count
            near = F.filter(F.transform(F.filter(known["middles"], lambda m: ~m.eqNullSafe(F.try_element_at(cuts, F.lit(-1)))), lambda m: F.struct(F.abs(m - ideal).alias("d"), m.alias("m"))), lambda x: x["d"] <= h * F.lit(layout.snap_radius))
            return F.concat(cuts, F.array(F.coalesce(F.array_min(near)["m"], ideal.cast("int"))))

        steps = F.when(count < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), count - 1))
        return F.array_sort(F.array_distinct(F.aggregate(steps, F.array().cast("array<int>"), snap)))

    return let(F.struct(section_count(height, ceiling, layout).alias("n"), middles.alias("middles")), fold)


def sections(cuts: Column, height: Column, ceiling: Column, layout: Layout = Layout()) -> Column:
    """Overlapping sections between the cuts; what exceeds the ceiling is given back where it was reached for."""

    def between(cuts: Column) -> Column:
        total = F.size(cuts) + 1
        reach = F.when(total > 1, (height.cast("double") * F.lit(layout.overlap_percent) / F.lit(100.0) / (total - 1)).cast("int")).otherwise(F.lit(0))

        def one(i: Column) -> Column:
            first, last = i == 0, i + 1 == total
            top = F.greatest(F.when(first, F.lit(0)).otherwise(F.get(cuts, i - 1)) - reach, F.lit(0))
            bottom = F.least(F.coalesce(F.get(cuts, i), height) + reach, height)
            excess = F.when(total > 1, F.greatest(bottom - top - ceiling, F.lit(0))).otherwise(F.lit(0))
            half = F.floor(excess / 2).cast("int")
            return F.struct(
                F.when(first, top).when(last, top + excess).otherwise(top + half).cast("int").alias("top"),
                F.when(first, bottom - excess).when(last, bottom).otherwise(bottom - (excess - half)).cast("int").alias("bottom"),
                i.alias("index"),
                total.alias("total"),
            )

        return F.when(height > 0, F.transform(F.sequence(F.lit(0), total - 1), one)).otherwise(F.array().cast(f"array<{SECTION}>"))

    return let(cuts, between)


def budget_size(width: Column, height: Column) -> Column:
    """(width, height) after scaling both sides alike into the pixel budget."""
    pixels = width.cast("bigint") * height.cast("bigint")
    factor = F.sqrt(F.lit(float(PIXEL_BUDGET)) / pixels)
    scaled = lambda x: F.when(pixels <= PIXEL_BUDGET, x).otherwise(F.greatest((x * factor).cast("int"), F.lit(1)))
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))


def render_width(aspect: Column) -> Column:
    return F.sqrt(F.lit(float(PIXEL_BUDGET)) / F.greatest(aspect.cast("float").cast("double"), F.lit(0.1))).cast("int")
