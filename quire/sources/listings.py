"""A device's listings as a table and as a stream: ``format("listings")``.

Each folder is a partition, so folders are asked in parallel and a folder that can't be read is a row with an error.
Options: ``origin``, and ``folders``, comma-separated ids ('' is the root, and all without the option). They are not
chosen by a filter that is pushed down: Spark keeps such a filter with the relation, so a second query over the same
DataFrame would see the first one's folders. A stream asks all folders again at every trigger; its offset is the number
of times that it asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quire.sources import device

SCHEMA = "folder string, body string, error string"


class Folder(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


def ask(origin: str, folder: str) -> tuple[str, str | None, str | None]:
    """(folder, body, error); an id that could be more than a path segment is not asked for."""
    if folder and not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", folder):
        return folder, None, "bad identifier"
    try:
        return folder, device.get(f"{origin}/documents/{folder}"), None
    except OSError as e:
        return folder, None, device.failure(e)


class Reader(DataSourceReader):
    def __init__(self, origin: str, folders: list[str]):
        self.origin, self.folders = origin, folders

    def partitions(self) -> list[Folder]:
        return [Folder(x) for x in self.folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield ask(self.origin, partition.folder)


class StreamReader(DataSourceStreamReader):
    def __init__(self, origin: str, folders: list[str]):
        self.origin, self.folders, self.asked = origin, folders, 0

    def initialOffset(self) -> dict:
        return {"asked": 0}

    def latestOffset(self) -> dict:
        self.asked += 1
        return {"asked": self.asked}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        self.asked = max(self.asked, end["asked"])
        return [Folder(x) for x in self.folders] if end["asked"] > start["asked"] else []

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield ask(self.origin, partition.folder)

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are done: a repeated batch asks again."""


class Listings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listings"

    def schema(self) -> str:
        return SCHEMA

    def folders(self) -> list[str]:
        return self.options.get("folders", "").split(",")

    def reader(self, schema) -> Reader:
        return Reader(self.options["origin"].rstrip("/"), self.folders())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["origin"].rstrip("/"), self.folders())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listings)


def listings(spark: SparkSession, origin: str, folders: list[str]) -> DataFrame:
    """(folder, body, error) of each folder."""
    register(spark)
    return spark.read.format("listings").option("origin", origin).option("folders", ",".join(folders)).load()
