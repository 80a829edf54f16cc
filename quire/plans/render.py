"""Finished documents as Markdown, JSON or plain text. Transcripts are (doc_id, source, model, processed, pages), where
``pages`` is an array of (number, text, sections) in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X

PAGES = "array<struct<number:int,text:string,sections:int>>"


def body() -> Column:
    return F.array_join(F.filter(F.transform("pages", lambda p: X.trim(p["text"])), lambda t: t != ""), "\n\n")


def _numbered(p: Column, head: str, tail: str) -> Column:
    return F.when(F.size("pages") > 1, F.concat(F.lit(head), p["number"].cast("string"), F.lit(tail))).otherwise(F.lit(""))


def markdown() -> Column:
    front = F.concat(F.lit("---\nsource: "), X.json_string(F.col("source")), F.lit("\nprocessed: "), F.col("processed"), F.lit("\npages: "), F.size("pages").cast("string"), F.lit("\nmodel: "), X.json_string(F.col("model")), F.lit("\n---\n\n"))
    return F.concat(front, F.array_join(F.transform("pages", lambda p: F.concat(_numbered(p, "## Page ", "\n\n"), X.trim(p["text"]), F.lit("\n"))), "\n\n"))


def plain_text() -> Column:
    head = F.concat(F.col("source"), F.lit(" — transcribed "), F.col("processed"), F.lit("\n\n"))
    pages = F.array_join(F.transform("pages", lambda p: F.concat(_numbered(p, "--- Page ", " ---\n\n"), X.trim(p["text"]), F.lit("\n\n"))), "")
    return F.concat(X.trim_end(F.concat(head, pages)), F.lit("\n"))


def json() -> Column:
    return F.to_json(F.struct("source", "model", "processed", "pages"), {"pretty": "true"})


def render(fmt: Column) -> Column:
    return F.when(fmt == "markdown", markdown()).when(fmt == "json", json()).otherwise(plain_text())


def filename(stem: Column, fmt: Column) -> Column:
    name = F.when(X.trim(X.text_of(stem)) == "", F.lit("transcript")).otherwise(X.trim(X.text_of(stem)))
    return F.concat(name, F.lit("."), F.when(fmt == "markdown", F.lit("md")).when(fmt == "json", F.lit("json")).otherwise(F.lit("txt")))


def paged(docs: DataFrame) -> DataFrame:
    """Documents as transcripts: every forty lines are a page."""
    parts = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("_l") - 1, F.lit(0)) / 40).cast("int")), lambda k: F.struct((k + 1).alias("number"), F.array_join(F.slice("_l", k * 40 + 1, F.lit(40)), "\n").alias("text"), F.lit(1).alias("sections"))), lambda p: p["number"] >= 1)
    return docs.withColumn("_l", X.lines("text")).select("doc_id", F.col("source"), F.coalesce("lang", F.lit("")).alias("model"), F.lit("2024-01-02T03:04:05Z").alias("processed"), parts.alias("pages"))


def save(rendered: DataFrame, folder: str) -> DataFrame:
    """Write one file for each document of (doc_id, name, body) as ``folder/doc_id/name``; (doc_id, name, bytes) written.

    ``folder`` is a URI of any file system that pyarrow knows. A file appears under its name when it is complete, so a
    repeated task leaves the same file. Names are the documents' own and may repeat, hence the folder for each.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for pdf in batches:
            sizes = []
            for doc, name, body in pdf.itertuples(index=False, name=None):
                data, at = body.encode(), f"{root}/{doc}"
                fs.create_dir(at, recursive=True)
                part = f"{at}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(data)
                fs.move(part, f"{at}/{name}")
                sizes.append(len(data))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "name": pdf["name"], "bytes": sizes})

    safe = rendered.select("doc_id", X.safe_filename("name").alias("name"), X.text_of("body").alias("body"))
    return safe.mapInPandas(write, "doc_id long, name string, bytes long")


def timestamp(spark: SparkSession) -> Column:
    """Now, in UTC, as text."""
    return F.date_format(F.convert_timezone(F.lit(spark.conf.get("spark.sql.session.timeZone")), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
