"""Mixing sources to target weights by Poisson replication.

Each document's count is the inverse of the Poisson distribution, at a uniform number hashed from the seed and its
doc_id, with its source's target repetition rate as the mean. The document is exploded by that count and the copies
are dealt over the cluster by a hash of (seed, doc_id, copy), then ordered by it in each partition: a global shuffle.

The mean rate of a source is ``epochs * total * weight / size``. Rates above ``PART`` are split into equal parts whose
independent draws are added, so no rate is cut off. Defined cases: a null source is a source of its own; a document
without a doc_id is hashed by its text instead; rows with the same doc_id draw the same count, and copies with equal
shuffle keys are ordered by their texts' hashes; a null or empty text has size 0, a source of size 0 has rate 0; very
long texts are only copied; an empty table gives an empty result. Columns of the input are kept, whatever their names,
except that ``rate``, ``n_copies``, ``copy_no`` and ``shuffle_key`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import join_unique, materialize, own_names, pack

#: Largest mean of one draw; at 200 the tail of a Poisson distribution with this mean is below 1e-90.
PART, LONGEST = 32.0, 200


def uniform(seed: int, salt: Column, key: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), salt.cast("string"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def identity(doc_id: Column, text: Column) -> Column:
    """What a document is hashed by."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def source_rates(docs: DataFrame, temperature: float = 0.5, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate, parts, cdf): weights are sizes in code points to the power ``temperature``, scaled to one."""
    sizes = materialize(docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("_size")), "sizes")
    total, weights = sizes.agg(F.sum("_size"), F.sum(F.pow(F.col("_size").cast("double"), F.lit(temperature)))).first()  # two numbers
    rate = F.when(F.col("_size") > 0, F.lit(epochs) * F.lit(total) * F.pow(F.col("_size").cast("double"), F.lit(temperature)) / F.lit(weights) / F.col("_size")).otherwise(F.lit(0.0))
    rated = sizes.select("_source", rate.alias("rate"))
    return with_distribution(rated)


def with_distribution(rated: DataFrame) -> DataFrame:
    """Add the cumulative distribution of one part's count to (``_source``, ``rate``)."""
    parts = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("_mean", F.col("rate") / F.col("parts"))
    first = F.exp(-F.col("_mean"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(LONGEST)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda acc, k: F.struct((acc["p"] * F.col("_mean") / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * F.col("_mean") / k)).alias("c")),
        lambda acc: acc["c"],
    )
    # Past where the sum stops growing all entries are equal; one of them is enough, and the last counts as 1.
    return parts.select("_source", "rate", "parts", cdf.alias("_cdf")).select("_source", "rate", "parts", F.slice(F.array_distinct("_cdf"), 1, F.greatest(F.size(F.array_distinct("_cdf")) - 1, F.lit(1))).alias("cdf"))


ADDED = ("rate", "n_copies", "copy_no", "shuffle_key")


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row a copy: the document's columns, ``rate``, ``n_copies``, ``copy_no`` and ``shuffle_key``; not yet shuffled."""
    row, at, back = pack(docs, [c for c in docs.columns if c.lower() not in ADDED])
    group = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?")).alias("group")
    body = at(text) if text in docs.columns else F.lit(None)
    own = docs.toDF(*own_names(docs)).select(*row).select("_row", group(at(source)), identity(at(doc_id), body).alias("key"), F.xxhash64(body).alias("tie"))
    joined = join_unique(own, rates.select(group(F.col("_source")), "rate", "parts", "cdf"), "group")
    count = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1),
        F.lit(0).cast("long"),
        lambda acc, j: acc + F.size(F.filter("cdf", lambda c: c <= uniform(seed, j, F.col("key")))),
    )
    counted = joined.select("_row", "key", "tie", "rate", count.alias("n_copies")).where(F.col("n_copies") > 0)
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    dealt = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("deal"), F.col("key"), F.col("copy_no").cast("string")))
    return copies.select(*back, "rate", "n_copies", "copy_no", dealt.alias("shuffle_key"), F.col("tie").alias("_tie"))


def mix(docs: DataFrame, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Replicate to the target weights and shuffle globally."""
    rates = materialize(source_rates(docs, temperature, epochs), "rates")
    copies = replicate(docs, rates, seed)
    out = copies.columns[:-1]
    plain = copies.toDF(*own_names(copies))  # the last column is the tie, whatever names the input has
    key, tie = plain.columns[-2:]
    return plain.repartition(key).sortWithinPartitions(key, tie).drop(tie).toDF(*out)
