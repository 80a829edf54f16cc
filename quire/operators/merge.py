"""Joining the texts of overlapping sections at fuzzy seams."""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

# Fixed values of the seam search.
ANCHOR, EXTEND, DEPTH = 0.80, 0.62, 14


def seam_candidates(pairs: DataFrame) -> DataFrame:
    """(page, index, n_above, n_below, i, j, a_blank, b_blank, sim): every line pair of a section's end and the next
    one's beginning. ``pairs`` has ``above`` and ``below`` as arrays of lines; at most DEPTH lines of each side meet,
    inside one row, and each line's bigrams are taken once.
    """
    with_grams = lambda ls: F.transform(ls, lambda x: F.struct(X.is_empty(x).alias("blank"), X.grams(x).alias("g")))
    tail = F.slice("above", F.greatest(F.size("above") - DEPTH + 1, F.lit(1)), DEPTH)
    offset = F.greatest(F.size("above") - DEPTH, F.lit(0))
    ends = F.struct(with_grams(tail).alias("tail"), with_grams(F.slice("below", 1, DEPTH)).alias("head"))
    meet = lambda e: F.flatten(F.transform(e["tail"], lambda x, i: F.transform(e["head"], lambda y, j: F.struct(
        (i + offset).alias("i"), j.alias("j"), x["blank"].alias("a_blank"), y["blank"].alias("b_blank"), X.dice(x["g"], y["g"]).alias("sim")))))
    return pairs.select("page", "index", F.size("above").alias("n_above"), F.size("below").alias("n_below"), F.inline(X.let(ends, meet)))


def line_facts(ls: Column) -> Column:
    """What a seam asks of each line; its bigrams are taken once."""
    return F.transform(ls, lambda x: F.struct(X.is_empty(x).alias("blank"), X.grams(x).alias("g")))


def meeting(x: Column, y: Column) -> Column:
    """(blank, goes, anchor, sim) of two lines' facts; lines whose lengths rule ``EXTEND`` out aren't compared."""
    a, b = F.size(x["g"]["grams"]), F.size(y["g"]["grams"])
    apart = (x["g"]["normal"] != y["g"]["normal"]) & (F.least(a, b) * 2.0 < (a + b) * (EXTEND - 0.01))
    blank = x["blank"] & y["blank"]
    told = lambda s: F.struct(blank.alias("blank"), (blank | (s >= EXTEND)).alias("goes"), (~x["blank"] & (s >= ANCHOR)).alias("anchor"), s.alias("sim"))
    return X.let(F.when(apart, F.lit(0.0)).otherwise(X.dice(x["g"], y["g"])), told)


def seam_at(tail: Column, head: Column, n_above: Column, n_below: Column, strict: bool, digits: int | None = None) -> Column:
    """(score, keep, resume) of the best seam between the last lines of ``n_above`` and the first of ``n_below``; a
    score of 0 says that there is none. Of equal scores (rounded to ``digits``) the first pair's counts.

    Each anchor walks down its diagonal of the pairs of lines while both lines are blank or alike.
    """
    value = lambda s: s if digits is None else F.round(s, digits)
    none = F.struct(F.lit(0.0).alias("score"), n_above.alias("keep"), F.lit(0).alias("resume"))

    def best(a: Column, b: Column) -> Column:
        wide, offset = F.size(b), n_above - F.size(a)

        def searched(cells: Column) -> Column:
            def walked(i: Column, j: Column) -> Column:
                first = F.struct(F.lit(True).alias("on"), F.lit(0).alias("run"), ((i + offset) / n_above + (1 - j / n_below) * 0.5).alias("score"))

                def step(s: Column, k: Column) -> Column:
                    longer = lambda c: F.struct(c["goes"].alias("on"), (s["run"] + c["goes"].cast("int")).alias("run"), (s["score"] + F.when(c["blank"] | ~c["goes"], F.lit(0.0)).otherwise(c["sim"] + 2)).alias("score"))
                    return F.when(s["on"], X.let(F.get(cells, (i + k) * wide + j + k), longer)).otherwise(s)

                return F.aggregate(F.sequence(F.lit(0), F.least(F.size(a) - i, wide - j) - 1), first, step)

            def better(s: Column, at: Column) -> Column:
                i, j = F.floor(at / wide).cast("int"), F.pmod(at, wide)
                ended = lambda w: F.when(value(w["score"]) > s["score"], F.struct(value(w["score"]).alias("score"), (i + offset + w["run"]).alias("keep"), (j + w["run"]).alias("resume"))).otherwise(s)
                return X.let(walked(i, j), ended)

            named = lambda at: F.lit(True) if not strict else F.get(a, F.floor(at / wide).cast("int"))["g"]["normal"] != ""
            anchors = F.filter(F.transform(cells, lambda c, at: F.when(c["anchor"], at)), lambda at: at.isNotNull() & named(at))
            return F.aggregate(anchors, none, better)

        return X.let(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: meeting(x, y)))), searched)

    return X.let(line_facts(tail), lambda a: X.let(line_facts(head), lambda b: best(a, b)))


def last_lines(ls: Column, n: int = DEPTH) -> Column:
    return F.slice(ls, F.greatest(F.size(ls) - n + 1, F.lit(1)), n)


def best_seams(pairs: DataFrame) -> DataFrame:
    """(page, index, keep, resume, score) of sections whose text alone stands above; no row without a seam. A seam is
    found inside its row."""
    found = seam_at(last_lines(F.col("above")), F.slice("below", 1, DEPTH), F.size("above"), F.size("below"), strict=False, digits=6)
    return pairs.select("page", "index", found.alias("b")).where("b.score > 0").select("page", "index", F.col("b.keep").cast("long").alias("keep"), F.col("b.resume").cast("long").alias("resume"), "b.score")


@functools.lru_cache(maxsize=4096)
def _grams(normal: str) -> Counter:
    return Counter(zip(normal, normal[1:]))


def similar(a: str, b: str) -> float:
    """Of two normal forms; the same as ``text.similarity`` of the lines."""
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    return 2.0 * (_grams(a) & _grams(b)).total() / (len(a) + len(b) - 2)


#: (line, normal form, whether it is blank)
Line = tuple[str, str, bool]


def seam(above: list[Line], below: list[Line], strict: bool) -> tuple[int, int]:
    """(keep, resume): how much of ``above`` stays, and where ``below`` goes on."""
    best, at = 0.0, (len(above), 0)
    for i in range(max(0, len(above) - DEPTH), len(above)):
        if above[i][2] or (strict and not above[i][1]):
            continue
        for j in range(min(DEPTH, len(below))):
            if similar(above[i][1], below[j][1]) < ANCHOR:
                continue
            run, score = 0, i / len(above) + 0.5 * (1 - j / len(below))
            for (_, a, a_blank), (_, b, b_blank) in zip(above[i:], below[j:]):
                if not (a_blank and b_blank):
                    s = similar(a, b)
                    if s < EXTEND:
                        break
                    score += 2 + s
                run += 1
            if score > best:
                best, at = score, (i + run, j + run)
    return at


def joined(merged: list[Line] | None, below: list[Line], strict: bool = True) -> list[Line]:
    """``merged``, which is changed, with the next section's lines."""
    if merged is None:
        return below
    keep, resume = seam(merged, below, strict)
    del merged[keep:]
    if not resume and not (merged and merged[-1][2]):
        merged.append(("", "", True))
    return merged + below[resume:]


def text_of(merged: list[Line] | None) -> str:
    """The lines without blank ones at either end."""
    full = [i for i, x in enumerate(merged or []) if not x[2]]
    return "\n".join(x[0] for x in merged[full[0] : full[-1] + 1]) if full else ""


def read_lines(answers: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with the lines of ``text``, their normal forms and whether they are blank; null for no answer."""
    return answers.withColumn("lines", X.lines("text")).select(*columns, "lines", F.transform("lines", X.normalise).alias("normals"), F.transform("lines", X.is_empty).alias("blanks"))


def merge_sections(sections: Column, strict: bool = True) -> Column:
    """The text of a page's sections (an array of arrays of lines), joined in order.

    The fold holds spans of the sections, not lines: (section, from, len, at), ``at`` being where the span stands in the
    merged page and section -1 one blank line. A seam reaches back at most DEPTH lines, so it looks at and cuts the last
    DEPTH spans only. Lines are copied once, at the end.
    """
    span = lambda k, start, n, at: F.array(F.struct(k.alias("section"), start.alias("from"), n.alias("len"), at.alias("at")))
    no_span = F.filter(span(F.lit(0), F.lit(0), F.lit(0), F.lit(0)), lambda x: F.lit(False))
    section = lambda k: F.get(sections, k)

    def lines_of(sp: Column, most: int | None = None) -> Column:
        n = sp["len"] if most is None else F.least(sp["len"], F.lit(most))
        return F.when(sp["section"] < 0, F.array(F.lit(""))).otherwise(F.slice(section(sp["section"]), sp["from"] + sp["len"] - n + 1, n))

    def step(s: Column, k: Column) -> Column:
        def meet(near: Column, below: Column) -> Column:
            def cut(tail: Column) -> Column:
                def grown(b: Column) -> Column:
                    glue = (b["resume"] == 0) & ~F.coalesce(X.is_empty(F.get(tail, F.size(tail) - 1)), F.lit(False))
                    clip = lambda sp: F.struct(sp["section"].alias("section"), sp["from"].alias("from"), F.least(sp["len"], b["keep"] - sp["at"]).alias("len"), sp["at"].alias("at"))
                    kept = F.filter(F.transform(near, clip), lambda sp: sp["len"] > 0)
                    before = F.slice(s["spans"], 1, F.greatest(F.size(s["spans"]) - DEPTH, F.lit(0)))
                    at, rest = b["keep"] + glue.cast("int"), F.size(below) - b["resume"]
                    added = F.when(rest > 0, span(k, b["resume"], rest, at)).otherwise(no_span)
                    blank = F.when(glue, span(F.lit(-1), F.lit(0), F.lit(1), b["keep"])).otherwise(no_span)
                    return F.struct((at + rest).alias("n"), F.concat(before, kept, blank, added).alias("spans"))

                return X.let(seam_at(tail, F.slice(below, 1, DEPTH), s["n"], F.size(below), strict), grown)

            return X.let(last_lines(F.flatten(F.transform(near, lambda sp: lines_of(sp, DEPTH)))), cut)

        return X.let(last_lines(s["spans"]), lambda near: X.let(section(k), lambda below: meet(near, below)))

    n = F.size(section(F.lit(0)))
    first = F.struct(n.alias("n"), F.when(n > 0, span(F.lit(0), F.lit(0), n, F.lit(0))).otherwise(no_span).alias("spans"))
    others = F.when(F.size(sections) > 1, F.sequence(F.lit(1), F.size(sections) - 1)).otherwise(F.array().cast("array<int>"))
    page = F.aggregate(others, first, step, lambda s: F.flatten(F.transform(s["spans"], lambda sp: lines_of(sp))))

    def trimmed(ls: Column) -> Column:
        ends = lambda blank: F.struct(F.array_position(blank, F.lit(False)).alias("first"), F.array_position(F.reverse(blank), F.lit(False)).alias("last"))
        within = lambda e: F.when(e["first"] == 0, F.lit("")).otherwise(F.array_join(F.slice(ls, e["first"].cast("int"), (F.size(ls) - e["last"] - e["first"] + 2).cast("int")), "\n"))
        return X.let(X.let(F.transform(ls, X.is_empty), ends), within)

    return X.let(page, trimmed)


def merge_pages(answers: DataFrame, key: str = "page", strict: bool = True) -> DataFrame:
    """(key, text): a page's answered sections joined in order, without what neighbours both read.

    The seam of a section depends on all that was merged before it, so a page is folded in its row. Sections without an
    answer are left out; without a seam, one blank line keeps two sections apart. ``strict`` forbids a seam at a line of
    punctuation only, which equals every other such line. Of rows with one index, the lesser text comes first.
    """
    read = answers.where(F.col("text").isNotNull()).groupBy(F.col(key).cast("long").alias(key))
    ordered = read.agg(F.array_sort(F.collect_list(F.struct("index", F.col("text").alias("text")))).alias("_in"))
    cut = ordered.select(key, F.transform("_in", lambda x: X.lines(x["text"])).alias("_in"))
    return cut.select(key, merge_sections(F.col("_in"), strict).alias("text"))
