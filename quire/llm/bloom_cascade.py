"""URL filters by a cascade of Bloom filters over the corpus's complete key universe.

Level 1 encodes the listed keys. Level 2 encodes the unlisted keys of the universe that level 1 lets pass, level 3 the
listed keys that level 2 lets pass, and so on until a level lets nothing pass wrongly. The parity of the first level
that rejects a key then tells whether it is listed, without error for every key of the universe and without a join.

The first level's rate of false positives follows from the ratio of listed to unlisted keys, so that the second level
has about half as many keys as the first, whatever the universe holds; all levels together take
``n * (1.44 * log2(unlisted / n) + 8)`` bits for n listed keys. Filters are made by Spark: probes become (word, bits) pairs
that are OR-ed by key. One cascade covers the keys of one hash shard; the number of shards follows from that size, and
each cascade is checked against ``max_bytes`` when it is made, which bounds what is collected and broadcast at once.

Rules (host, path) fit a host and its subdomains and paths that start with theirs: a url's candidate keys are its
host's suffixes joined with its path's beginnings of the lengths that rules have; the longest listed candidate wins.
The rules are a parameter of the driver program, and their cascades a few bytes a rule.

Defined cases: a url that is null or has no ``://`` has an empty host and path and no candidates; rows with equal
urls get equal verdicts; a url of any length is one key; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.storage import materialize

#: (host, path, verdict) of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Level:
    words: np.ndarray  # uint64
    probes: int
    number: int = 0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host are lower-cased; both are empty without ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def mixed(h: np.ndarray, number: int) -> np.ndarray:
    """A hash for each level: keys that collide on one level must not do so on all."""
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (number + 1) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def positions(h1, h2, number: int, probes: int, n_bits: int) -> np.ndarray:
    """Rows of bit positions on level ``number`` by double hashing; ``h1`` and ``h2`` are int64 arrays."""
    a, b = mixed(h1, number), mixed(h2, number) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + b[:, None] * np.arange(probes, dtype=np.uint64)[None, :]) % np.uint64(n_bits)


def passes(level: Level, h1, h2) -> np.ndarray:
    if not len(level.words):
        return np.zeros(len(h1), bool)
    at = positions(h1, h2, level.number, level.probes, len(level.words) * 64)
    return ((level.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def build_level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A filter of ``count`` keys (h1, h2) with about that rate of false positives."""
    if not count:
        return Level(np.zeros(0, np.uint64), 1)
    n_words = math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64) + 1
    probes = max(1, round(-math.log2(rate)))

    def marks(batches):
        for pdf in batches:
            at = np.unique(positions(pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), number, probes, n_words * 64))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            yield pd.DataFrame({"word": word[first], "bits": (np.bitwise_or.reduceat(bit, first) if len(first) else bit).astype(np.int64)})

    got = keys.select("h1", "h2").mapInPandas(marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(n_words, np.uint64)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint64)
    return Level(words, probes, number)


def let_pass(spark: SparkSession, keys: DataFrame, level: Level) -> DataFrame:
    shared = spark.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def ok(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, h1.to_numpy(), h2.to_numpy()))

    return keys.where(ok("h1", "h2"))


def first_rate(listed: int, unlisted: int, most: float = 0.5) -> float:
    """The rate of false positives at which level 2 has about half as many keys as level 1."""
    return min(most, max(1, listed) / (2 * max(1, unlisted)))


def cascade_bytes(listed: int, unlisted: int) -> int:
    """About the size of all levels of a cascade."""
    return math.ceil(listed * (1.4427 * math.log2(1 / first_rate(listed, unlisted)) + 8) / 8) + 64


def build_cascade(universe: DataFrame, rate: float = 0.5, tag: str = "keys", max_bytes: int | None = None) -> list[Level]:
    """The levels for a universe of distinct keys (h1, h2, listed), with few keys left after each level."""
    spark = universe.sparkSession
    inside, outside = universe.where("listed").select("h1", "h2"), universe.where("not listed").select("h1", "h2")
    levels: list[Level] = []
    count, others = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    first = first_rate(count, others)
    while count:
        level = build_level(inside, count, rate if levels else first, len(levels))
        levels.append(level)
        if max_bytes and sum(x.words.nbytes for x in levels) > max_bytes:
            raise ValueError(f"a cascade of {sum(x.words.nbytes for x in levels)} bytes is over the bound of {max_bytes}")
        inside, outside = materialize(let_pass(spark, outside, level), tag), inside
        count = inside.count()
    return levels


def member(levels: list[Level], h1, h2) -> np.ndarray:
    """Exact membership for keys of the universe."""
    listed = np.full(len(h1), len(levels) % 2 == 1)
    alive = np.ones(len(h1), bool)
    for k, level in enumerate(levels):
        rejected = alive & ~passes(level, h1, h2)
        listed[rejected] = k % 2 == 1
        alive &= ~rejected
    return listed & (len(levels) > 0)


def shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("h2", 7), F.lit(shards)).cast("int")


def build_cascades(universe: DataFrame, max_bytes: int = 64 << 20, tag: str = "keys") -> list[list[Level]]:
    """One cascade a shard. Shards are planned at half of ``max_bytes``, as hashes deal keys out unevenly."""
    listed, unlisted = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    shards = max(1, math.ceil(2 * cascade_bytes(listed, unlisted) / max_bytes))
    return [build_cascade(universe.where(shard_of(shards) == k) if shards > 1 else universe, tag=f"{tag}{k}", max_bytes=max(max_bytes, 4096)) for k in range(shards)]


def member_udf(shared):
    @F.pandas_udf("boolean")
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(member(shared.value, h1.to_numpy(), h2.to_numpy()))

    return listed


def with_membership(df: DataFrame, cascades: list[list[Level]], key: str, name: str) -> DataFrame:
    """Add ``name``: whether column ``key`` is listed. Each shard is one pass with only its own filters broadcast."""
    spark, n = df.sparkSession, len(cascades)
    keyed = df.select("*", *hashes(F.col(key)))
    out = None
    for k, levels in enumerate(cascades):
        part = keyed.where(shard_of(n) == k) if n > 1 else keyed
        part = part.withColumn(name, member_udf(spark.sparkContext.broadcast(levels))("h1", "h2")).drop("h1", "h2")
        out = part if out is None else out.unionAll(part)
    return out


def universe_of(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (key, h1, h2, listed) of the corpus's keys and the listed ones, by one aggregation."""
    both = keys.select("key", F.lit(False).alias("listed")).unionAll(listed.select("key", F.lit(True).alias("listed")))
    return both.groupBy("key").agg(F.max("listed").alias("listed")).select("key", *hashes(F.col("key")), "listed")


def candidates(rules) -> Column:
    """Array of the candidate keys of (host, path), longest first."""
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    heads = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(heads, lambda h: h.isNotNull()), lambda h: F.concat(s, h))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def mirrored_keys(pages: DataFrame) -> DataFrame:
    """Listed keys for a page table without a block list of its own: urls that the crawl holds under more than one
    page_id, as recrawled copies; the key is host and path. A verdict is a function of the url, so all copies get the
    same one; keeping one of them is deduplication, not filtering."""
    return pages.where(F.col("key") != "").groupBy("key").agg(F.count_distinct("page_id").alias("n")).where("n > 1").select("key")


def filter_urls(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict). ``listed``: a block list of keys (host and path) for urls without a rule;
    without one it is ``mirrored_keys``."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    parts = materialize(parts.withColumn("key", F.concat("host", "path")), "urls")
    listed = mirrored_keys(parts) if listed is None else listed.select("key")

    exact = build_cascades(materialize(universe_of(parts.select("key").where("key <> ''"), listed), "universe"), tag="listed")
    rule_keys = spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, rule_verdict string")
    wanted = parts.select(F.explode(candidates(rules)).alias("key"))
    ruled = {}
    for v in ("allow", "block"):
        ruled[v] = build_cascades(materialize(universe_of(wanted, rule_keys.where(F.col("rule_verdict") == v)), f"rules-{v}"), tag=v)

    shared = spark.sparkContext.broadcast(ruled)

    @F.pandas_udf("array<string>")
    def verdicts(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy()
        a, b = (np.concatenate(x.to_list() or [np.zeros(0, np.int64)]).astype(np.int64) for x in (h1, h2))
        said = np.full(len(a), "", object)
        for v, cascades in shared.value.items():
            shard = ((b >> 7) % len(cascades)).astype(np.int64)
            for k, levels in enumerate(cascades):
                hit = shard == k
                said[np.flatnonzero(hit)[member(levels, a[hit], b[hit])]] = v
        return pd.Series([list(x) for x in np.split(said, np.cumsum(sizes)[:-1])] if len(sizes) else [], dtype=object)

    tried = parts.withColumn("_keys", candidates(rules))
    tried = tried.withColumn("_said", verdicts(F.transform("_keys", lambda k: F.xxhash64(k)), F.transform("_keys", lambda k: F.xxhash64(k, F.lit("second")))))
    hits = F.filter(F.arrays_zip("_keys", "_said"), lambda x: x["_said"] != "")
    longest = F.element_at(F.sort_array(F.transform(hits, lambda x: F.struct(F.length(x["_keys"]).alias("n"), x["_keys"].alias("rule"), x["_said"].alias("verdict"))), asc=False), 1)
    tried = tried.withColumn("_hit", F.when(F.size(hits) > 0, longest)).select("page_id", "host", "path", "key", F.col("_hit.rule").alias("rule"), F.col("_hit.verdict").alias("_ruled"))
    judged = with_membership(tried, exact, "key", "_listed")
    verdict = F.coalesce("_ruled", F.when(F.col("_listed") & (F.col("key") != ""), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
