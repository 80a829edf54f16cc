"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a temporary folder serves a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quire/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a query are deleted as soon as that query ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and gives the planner the true size of the table, so that
    a small one is broadcast by the size check of ``spark.sql.autoBroadcastJoinThreshold`` and a large one isn't.
    """
    path = fresh_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables, each as ``materialize`` returned it, that no later job reads; a folder elsewhere is left alone."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if f"/quire/{context.applicationId}/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(df: DataFrame, key: str, total: int | None = None, share: int = 1000) -> DataFrame:
    """(key) of the keys that hold more than one in ``share`` of the ``total`` rows, of which there are fewer than
    ``share``."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.count() if total is None else total
    return materialize(counts.where(F.col("_n") * share > total).select(key), "hot")


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right`` while a few keys may hold much of ``left``.

    Unless the ``hot`` keys are given, ``right`` is broadcast if it has at most 1,000 rows. Else rows of ``left`` with a hot key stay where they are and
    meet a broadcast of fewer than 1,000 rows; the others are joined as Spark chooses, and none of their keys has more
    than a thousandth of the rows. Both sides should be tables, as they are read more than once.
    """
    if hot is None:
        if right.limit(1001).count() <= 1000:
            return left.join(F.broadcast(right), key)
        hot = hot_keys(left, key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    apart = left.join(F.broadcast(few), key)
    return apart.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))


def pack(docs: DataFrame, columns: list[str] | None = None) -> tuple[list[Column], Callable[[str], Column], list[Column]]:
    """What lets an operator add columns without a clash: (row, at, back).

    ``docs.toDF(*own_names(docs)).select(*row)`` has the one column ``_row``; ``at(name)`` is a field of it, and ``back``
    are the columns (all, or those named) under their names again.
    """
    names = own_names(docs)
    at = lambda c: F.col(f"_row.{names[docs.columns.index(c)]}")
    back = [F.col(f"_row.{n}").alias(c) for n, c in zip(names, docs.columns) if columns is None or c in columns]
    return [F.struct(*names).alias("_row")], at, back


def own_names(docs: DataFrame) -> list[str]:
    return [f"c{k}" for k in range(len(docs.columns))]


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever others are named, in another case or with dots."""
    return df.toDF(*own_names(df)).select(*(F.col(f"c{df.columns.index(n)}").alias(n) for n in names))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
