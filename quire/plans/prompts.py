"""Prompts for the sections of a page, and the requests that carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as X

BASE = "Write down what this image says as Markdown, line by line.\n"
TOP, BOTTOM, MIDDLE = "Top section", "Bottom section", "Middle section"
CUT_BELOW = "The last line may be cut; leave it to the next section.\n"
SEEN_ABOVE = "The first lines were read already; go on after them.\n"
BOTH = "The first lines were read already and the last line may be cut.\n"


def for_section(index: Column, total: Column, previous: Column) -> Column:
    """The base alone for a whole page; else with the section's place, its edges and the end of the one above."""
    place = lambda what: F.concat(F.lit(f"\n{what}, "), (index + 1).cast("string"), F.lit(" of "), total.cast("string"), F.lit(".\n"))
    where = F.when(index == 0, F.concat(place(TOP), F.lit(CUT_BELOW))).when(index + 1 >= total, F.concat(place(BOTTOM), F.lit(SEEN_ABOVE))).otherwise(F.concat(place(MIDDLE), F.lit(BOTH)))
    tail = X.tail_lines(previous)
    context = F.when((index > 0) & tail.isNotNull(), F.concat(F.lit("\nThe section above ended so:\n```\n"), tail, F.lit("\n```\n"))).otherwise(F.lit(""))
    return F.when(total <= 1, F.lit(BASE)).otherwise(F.concat(F.lit(BASE), where, context))
