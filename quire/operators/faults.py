"""Well-formedness of transcripts: one rule a function, each row-local and without a shuffle."""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.operators.merge import similar
from quire.operators.recall import row_key

# Fixed values of the rules.
OPENERS = ("here is", "here's", "sure,", "certainly", "i've transcribed", "the transcription", "below is")
REPEATS, BLOCK, MEATY_BYTES, SAME, PASS_RECALL = 4, 3, 8, 0.9, 0.85

#: Lines of a text above which candidates are searched by their rarest bigrams instead of by all lags.
MANY = 600


def opens_with_fence(c: Column) -> Column:
    return X.trim_start(c).startswith("```")


def preamble(ls: Column) -> Column:
    """The first line that isn't blank, if it answers instead of transcribing."""
    first = X.trim(F.get(F.filter(ls, lambda x: ~X.is_empty(x)), 0))
    low = F.lower(first)
    hit = low.startswith(OPENERS[0])
    for o in OPENERS[1:]:
        hit = hit | low.startswith(o)
    return F.when(hit, first)


def rule_between_bullets(ls: Column) -> Column:
    """Place of the first rule whose nearest lines that aren't blank are both bullets."""
    return X.let(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda p: ~X.is_empty(p["x"])), lambda full: F.get(F.filter(
        F.transform(full, lambda p, k: F.when(X.is_rule(p["x"]) & X.is_bullet(F.get(full, k - 1)["x"]) & X.is_bullet(F.get(full, k + 1)["x"]), p["at"])), lambda v: v.isNotNull()), 0))


def odd_indent(ls: Column) -> Column:
    """Place and indent of the first bullet whose indent is odd."""
    return F.get(F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("at"), X.indent_bytes(x).alias("indent"), X.is_bullet(x).alias("b"))), lambda p: p["b"] & (p["indent"] % 2 != 0)), 0)


def repetition(ls: Column) -> Column:
    """Where the first run of four equal lines starts that aren't blank."""
    return X.let(F.transform(ls, X.trim), lambda ts: F.get(F.filter(F.transform(ts, lambda t, i: F.when(
        (t != "") & (t == F.get(ts, i + 1)) & (t == F.get(ts, i + 2)) & (t == F.get(ts, i + 3)), i)), lambda v: v.isNotNull()), 0))


def numbered_grams(normal: str) -> list[tuple[str, int]]:
    """Bigrams with the number of their occurrence, so that sets of them act as multisets."""
    seen: Counter = Counter()
    out = []
    for g in map("".join, zip(normal, normal[1:])):
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def alike(normals: list[str]) -> list[set[int]]:
    """For each of some distinct normal forms those with a similarity above SAME, itself included.

    Two such forms share one of the rarest grams of each: with m grams, all but 9/11 of them and one more.
    """
    grams = [frozenset(numbered_grams(x)) for x in normals]
    common = Counter(g for x in grams for g in x)
    holders: dict[tuple[str, int], list[int]] = {}
    found = [{k} for k in range(len(normals))]
    for k, x in enumerate(grams):
        rare = sorted(x, key=lambda g: (common[g], g))[: len(x) - math.ceil(len(x) * SAME / (2 - SAME)) + 1]
        for j in {j for g in rare for j in holders.get(g, ())}:
            m, n = len(x), len(grams[j])
            if 2 * min(m, n) > SAME * (m + n) and 2.0 * len(x & grams[j]) / (m + n) > SAME:
                found[k].add(j)
                found[j].add(k)
        for g in rare:
            holders.setdefault(g, []).append(k)
    return found


def likely_copies(normals: list[str]) -> Iterator[tuple[int, int]]:
    """(first, second) places of blocks of three lines that may be alike, in order, of a text of not too many lines.

    Lines of m and n bigrams with a similarity above SAME differ in fewer than (1 - SAME) * (m + n) bigrams, hence in at
    most two letters more; letters are counted in 64 bins. All lags are tried, each for all places at once.
    """
    n = len(normals)
    sizes = np.array([len(x) for x in normals])
    codes = np.frombuffer("".join(normals).encode("utf-32-le"), np.uint32)
    counts = np.bincount(np.repeat(np.arange(n), sizes) * 64 + (codes & 63), minlength=64 * n).reshape(n, 64).astype(np.int32)
    close = []
    for lag in range(BLOCK, n - BLOCK + 1):
        apart = np.abs(counts[:-lag] - counts[lag:]).sum(axis=1)
        near = apart <= (1 - SAME) * (sizes[:-lag] + sizes[lag:]) + 2
        close += [(p, p + lag) for p in np.flatnonzero(near[:-2] & near[1:-1] & near[2:]).tolist()]
    yield from sorted(close)


def first_copy(normals: list[str]) -> list[int] | None:
    """Places of the first two blocks of three lines that are alike, of the normal forms of lines."""
    if len(normals) > MANY:
        return first_copy_of_many(normals)
    alike = lambda p, q: all(similar(normals[p + o], normals[q + o]) > SAME for o in range(BLOCK))
    return next(([p, q] for p, q in likely_copies(normals) if alike(p, q)), None)


def first_copy_of_many(normals: list[str]) -> list[int] | None:
    """The same, through the rarest bigrams of each line, so that time grows with the lines and their partners only."""
    kinds = {x: k for k, x in enumerate(dict.fromkeys(normals))}
    own, close = [kinds[x] for x in normals], alike(list(kinds))
    places: dict[int, list[int]] = {}
    for p, k in enumerate(own):
        places.setdefault(k, []).append(p)
    for p in range(len(own) - BLOCK):
        one, two, three = (close[own[p + o]] for o in range(BLOCK))
        later = (places[k][bisect.bisect_left(places[k], p + BLOCK) :] for k in one)
        q = min((next((q for q in some if q + 2 < len(own) and own[q + 1] in two and own[q + 2] in three), len(own)) for some in later), default=len(own))
        if q < len(own):
            return [p, q]
    return None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _copies(normals: pd.Series) -> pd.Series:
    return normals.map(lambda xs: first_copy(list(xs)) if xs is not None and len(xs) >= 2 * BLOCK else None)


def duplicated_block(ls: Column) -> Column:
    """Two places where the same three lines start, or null; short lines don't count."""
    meaty = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda p: F.octet_length(X.trim(p["x"])) > MEATY_BYTES)
    found = _copies(F.transform(meaty, lambda p: X.normalise(p["x"])))
    return F.when(found.isNotNull(), F.transform(found, lambda k: F.get(meaty, k)["at"]))


def fault_details(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, one column a rule): null where a rule holds; an empty text breaks ``not empty`` only."""
    df = docs.select("doc_id", *keep, F.col(text).alias("_text"), X.lines(text).alias("_lines"))
    empty = X.is_empty(X.text_of("_text"))
    unless = lambda v: F.when(~empty, v)
    return df.select(
        "doc_id",
        *keep,
        empty.alias("empty"),
        (~empty & opens_with_fence(X.text_of("_text"))).alias("fence"),
        unless(preamble(F.col("_lines"))).alias("preamble"),
        unless(rule_between_bullets(F.col("_lines"))).alias("rule_at"),
        unless(odd_indent(F.col("_lines"))["at"]).alias("odd_at"),
        unless(odd_indent(F.col("_lines"))["indent"]).alias("odd_indent"),
        unless(repetition(F.col("_lines"))).alias("repeat_at"),
        F.col("_lines").alias("_lines"),
    )


def fault_names(details: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, faults): the broken rules in order, joined by ``; ``."""
    rules = F.array(
        F.when(F.col("empty"), F.lit("not empty")),
        F.when(F.col("fence"), F.lit("no code fence")),
        F.when(F.col("preamble").isNotNull(), F.lit("no preamble")),
        F.when(F.col("rule_at").isNotNull(), F.lit("no rule between bullets")),
        F.when(F.col("odd_at").isNotNull(), F.lit("nesting in twos")),
        F.when(F.col("repeat_at").isNotNull(), F.lit("no repetition loop")),
        F.when(~F.col("empty") & F.col("copy_at").isNotNull(), F.lit("no duplicated seam")),
    )
    named = details.withColumn("copy_at", duplicated_block(F.col("_lines")))
    return named.select("doc_id", *keep, F.filter(rules, lambda r: r.isNotNull()).alias("faults"))


def grade(docs: DataFrame, recalled: DataFrame, doubts_expected: DataFrame) -> DataFrame:
    """One score a document, repeated ones too: passed means no fault and a recall of at least PASS_RECALL.

    All but the recall is found out row by row; ``recalled`` is ``recall_by_row`` of the same documents. ``doubts_expected``
    (doc_id, expected): a warning where doubts are expected and none is marked.
    """
    text = X.text_of("text")
    marks = docs.select("doc_id", "text", row_key(), X.unclear_count("text").alias("uncertainty"), F.length(text).alias("characters"), X.is_empty(text).alias("_empty"))
    keep = ("_row", "uncertainty", "characters", "_empty")
    named = fault_names(fault_details(marks, keep=keep), keep)
    expected = doubts_expected.groupBy("doc_id").agg(F.bool_or("expected").alias("expected"))
    joined = named.join(recalled, "_row").join(expected, "doc_id", "left")
    warned = F.coalesce("expected", F.lit(False)) & (F.col("uncertainty") == 0) & ~F.col("_empty")
    passed = (F.size("faults") == 0) & (F.col("fraction") >= PASS_RECALL)
    return joined.select("doc_id", "_row", "found", "total", "fraction", F.array_join("faults", "; ").alias("faults"), warned.alias("warned"), "uncertainty", "characters", passed.alias("passed"))


def cases(df: DataFrame, wanted: str | None, name: str = "name") -> DataFrame:
    """The cases whose name contains ``wanted``; all without it."""
    return df.where(F.contains(F.col(name), F.lit(wanted))) if wanted else df


def announce(scores: DataFrame, missed: DataFrame) -> DataFrame:
    """(doc_id, verdict, said): the lines that are told of each case, of scores and ``missing_by_row``."""
    whole = F.floor(F.col("fraction") * 100 + 0.5).cast("string")
    head = F.concat(F.lit("recall "), F.col("found").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), whole, F.lit("%), "), F.col("characters").cast("string"), F.lit(" chars, "), F.col("uncertainty").cast("string"), F.lit(" unclear"))
    lines = F.array(head, F.when(F.col("faults") != "", F.concat(F.lit("faults: "), "faults")), F.when(F.col("warned"), F.lit("warning: doubts expected, none marked")), F.when(F.col("missing") != "", F.concat(F.lit("missed: "), "missing")))
    joined = scores.join(missed, "_row")
    return joined.select("doc_id", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("verdict"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("said"))


def report(scores: DataFrame) -> DataFrame:
    """(passed, total, mean_recall) over all documents."""
    return scores.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.round(F.avg("fraction"), 9).alias("mean_recall"))
