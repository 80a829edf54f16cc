"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Every document gets integer measures by built-in functions. A sketch of a measure counts log-linear buckets: values
below 64 have a bucket each, above that a bucket keeps the six leading bits (relative error below 1/32), so a sketch
has a few hundred counters at most and two sketches merge by adding counts. Sketches are made per (language, source),
merged into languages and into one for all; a group with fewer than ``min_docs`` documents takes the sketch of its
language, then of all. A threshold lies ``reach`` quartile ranges beyond the quartiles plus a slack that shrinks
with the document's length, since a short text's ratios scatter more. Documents join the thresholds of their group;
groups with much of all rows are joined apart from the rest.

Defined cases: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows each count; an empty table gives an empty result; other columns are kept as they are, whatever
their names, except that the counts, ``base_failed`` and ``kept`` replace columns of these names. A text of any length
is counted whole, within one row, in arrays of its words' hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import join_unique, materialize, own_names, pack

#: The word separators of the contract: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Columns that this operator adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("symbol_pm", "dup_pm", "repeat_pm", "word_len_c")


@dataclass(frozen=True)
class Rules:
    """``slack`` and ``scatter`` (divided by the root of n_words) are in the measures' units, in their order."""

    min_docs: int = 50
    reach: int = 3
    slack: tuple[int, ...] = (50, 150, 60, 60)
    scatter: tuple[int, ...] = (300, 1500, 600, 600)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column) -> Column:
    """Words in windows of five that occur twice or more, given the array of the words' hashes."""
    windows = F.when(F.size(hashes) < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]))
    )

    def covered(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(by_hash, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"])))
        gaps = let(twice, lambda p: F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))

    return let(windows, covered)


def with_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(_row, lang_key, source_key, counts of the contract, n_lines with a word, base_failed); ``_row`` is the document."""
    row, at, _ = pack(docs)
    kept = ("_row", group_key(at(lang)).alias("lang_key"), group_key(at(source)).alias("source_key"))
    body = F.coalesce(at(text), F.lit(""))
    inner = F.trim(body, F.lit(SPACE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \x09-\x0D]+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    # Each array is bound once inside its own expression: a filter on the counts may be pushed below them.
    by_word = let(F.transform(words, lambda x: F.xxhash64(x)), lambda hs: F.struct(F.size(hs).alias("n"), repeated_words(hs).alias("twice")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    df = docs.toDF(*own_names(docs)).select(*row).select(*kept, body.alias("body"), by_word.alias("words"), by_line.alias("lines"))
    body = F.col("body")
    without = lambda drop: F.length(body) - F.length(F.translate(body, drop, ""))
    df = df.select(
        "_row", "lang_key", "source_key",
        F.col("words.n").cast("long").alias("n_words"),
        (F.length(body) - without(SPACE)).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.col("words.twice").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measures() -> list[Column]:
    """Per mille of symbols, repeated lines and repeated words, and the mean word length in hundredths."""
    share = lambda a, b, by: F.expr(f"({by} * {a}) div greatest({b}, 1)")
    return [share("n_symbols", "word_chars", 1000), share("n_dup_lines", "n_lines", 1000), share("n_repeat_words", "n_words", 1000), share("word_chars", "n_words", 100)]


def bucket(value: Column) -> Column:
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def group_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang_key, source_key, measure, bucket, n) over the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(m).alias("bucket")) for k, m in enumerate(measures())])
    return counted.where(~F.col("base_failed")).select("lang_key", "source_key", F.inline(pairs)).groupBy("lang_key", "source_key", "measure", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """The sketches of level 0 (language and source), 1 (language) and 2 (all) by adding counts."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lk"), b.alias("sk")) for k, (a, b) in enumerate(((F.col("lang_key"), F.col("source_key")), (F.col("lang_key"), F.lit("*")), (F.lit("*"), F.lit("*"))))])
    return sketch.select(F.inline(levels), "measure", "bucket", "n").groupBy("level", "lk", "sk", "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, lk, sk, n_docs, q1, q3): arrays by measure; a sketch's buckets are few, whatever it has counted."""
    by = ("level", "lk", "sk", "measure")
    own = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    cut = lambda share: F.aggregate(  # noqa: E731  the least bucket with ``share`` quarters of the counts at or below it
        "b", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("q")),
        lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.coalesce(acc["q"], F.when(4 * (acc["n"] + x["n"]) >= share * F.col("total"), x["bucket"])).alias("q")),
        lambda acc: acc["q"],
    )
    cuts = sketch.groupBy(*by).agg(own.alias("b"), F.sum("n").alias("total")).select(*by, "total", cut(1).alias("q1"), cut(3).alias("q3"))
    ordered = lambda q: F.transform(F.array_sort(F.collect_list(F.struct("measure", q))), lambda x: x[q])
    return cuts.groupBy("level", "lk", "sk").agg(F.max("total").alias("n_docs"), ordered("q1").alias("q1"), ordered("q3").alias("q3"))


def thresholds(counted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang_key, source_key, low, high): arrays by measure, from the finest level with enough documents."""
    own = materialize(sketches(counted), "sketches")
    levels = materialize(quartiles(merged(own)), "quartiles")
    groups = own.select("lang_key", "source_key").distinct()
    pick = groups.select("lang_key", "source_key", F.inline(F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lk"), b.alias("sk")) for k, (a, b) in enumerate(((F.col("lang_key"), F.col("source_key")), (F.col("lang_key"), F.lit("*")), (F.lit("*"), F.lit("*"))))])))
    found = pick.join(levels, ["level", "lk", "sk"]).where((F.col("n_docs") >= rules.min_docs) | (F.col("level") == 2))
    best = found.groupBy("lang_key", "source_key").agg(F.min_by(F.struct("q1", "q3"), "level").alias("q"))
    edge = lambda sign, q: F.transform(F.col(f"q.{q}"), lambda x, i: x + sign * rules.reach * (F.get("q.q3", i) - F.get("q.q1", i)))
    return best.select("lang_key", "source_key", edge(-1, "q1").alias("low"), edge(1, "q3").alias("high"))


def verdict(rules: Rules = Rules()) -> Column:
    """Whether a document with its group's ``low`` and ``high`` passes; only the word length has a lower bound."""
    checks = []
    for k, m in enumerate(measures()):
        slack = F.lit(rules.slack[k]) + F.lit(rules.scatter[k]) / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
        checks.append(m <= F.get("high", F.lit(k)) + slack)
        if MEASURES[k] == "word_len_c":
            checks.append(m >= F.get("low", F.lit(k)) - slack)
    passed = checks[0]
    for c in checks[1:]:
        passed = passed & c
    return ~F.col("base_failed") & F.coalesce(passed, F.lit(True))


def judge(docs: DataFrame, rules: Rules = Rules(), columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the documents (default: all) with the counts, ``base_failed`` and ``kept``.

    The counted table is written once in the shared folder, since both the sketches and the filter read it.
    """
    added = (*COUNTS, "base_failed", "kept")
    shown = [c for c in (docs.columns if columns is None else columns) if c not in added]
    need = docs.select(*dict.fromkeys([*shown, "lang", "source", "text"]))
    row, _, back = pack(need, shown)
    wanted = with_counts(need)
    if "text" not in shown:
        wanted = wanted.withColumn("_row", F.col("_row").dropFields(own_names(need)[need.columns.index("text")]))
    counted = materialize(wanted, "counted")
    limits = thresholds(counted, rules)
    groups = counted.select("lang_key", "source_key").distinct().join(limits, ["lang_key", "source_key"], "left")
    limits = materialize(groups.select(F.struct("lang_key", "source_key").alias("group"), "low", "high"), "thresholds")
    keyed = counted.withColumn("group", F.struct("lang_key", "source_key"))
    return join_unique(keyed, limits, "group").select(*back, *COUNTS, "base_failed", verdict(rules).alias("kept"))
