"""A run as a stream: answers arrive in files, and each page's state is updated as they do.

An extension: the batch operators of ``quire.operators.job`` give the same results on a finished run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "answered long, lapsed long, characters long"
OUT = f"page long, {STATE}"


def page_progress(answers: DataFrame) -> DataFrame:
    """(page, answered, lapsed, characters) so far, whenever a page gets answers; ``answers`` is a stream of
    (page, index, text, lapse)."""
    characters = F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0).cast("long"))
    return answers.groupBy("page").agg(F.count("text").alias("answered"), F.count("lapse").alias("lapsed"), characters.alias("characters"))


def run_once(spark: SparkSession, updates: DataFrame, folder: str) -> DataFrame:
    """Run a stream of updates over what is there now, append each batch as Parquet in ``folder``, and return the
    latest state of each page."""

    def append(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    written = spark.read.schema(OUT + ", batch long").parquet(f"{folder}/out/batch=*")
    return written.groupBy("page").agg(F.max_by(F.struct("answered", "lapsed", "characters"), "batch").alias("s")).select("page", "s.*")
