"""A device's folder listings over HTTP, walked level by level."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import wire as V
from quire.functions.text import safe_filename, valid_id
from quire.sources.tables import shared_folder, written

# Fixed values of the device's interface.
LOOPBACK, DEVICE_PORT, TIMEOUT_S = "127.0.0.1", 80, 20

#: Body of a URL; raises OSError.
Get = Callable[[str], str]


def get_bytes(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT_S) as r:
        return r.read()


def get(url: str) -> str:
    return get_bytes(url).decode("utf-8", errors="replace")


def failure(error: Exception) -> str:
    """``cancelled`` for an interrupted request, ``unreachable: ...`` for what a wrong address or a sleeping device causes, else ``transport: ...``."""
    cause = getattr(error, "reason", error)
    if isinstance(cause, (InterruptedError, KeyboardInterrupt)):
        return "cancelled"
    if isinstance(error, urllib.error.HTTPError):
        return f"transport: {error.code}"
    return f"{'unreachable' if isinstance(cause, (ConnectionError, TimeoutError, OSError)) else 'transport'}: {cause}"


def tunnel_origin(port: int) -> str:
    return f"http://{LOOPBACK}:{port}"


def tunnel_command(host: Column, user: Column, port: Column) -> Column:
    """Arguments of a port forward to the device, never a shell string."""
    forward = F.concat(F.lit(f"{LOOPBACK}:"), port.cast("string"), F.lit(f":{LOOPBACK}:{DEVICE_PORT}"))
    fixed = ["ssh", "-N", "-o", "ExitOnForwardFailure=yes", "-o", "StrictHostKeyChecking=accept-new", "-L"]
    return F.array(*map(F.lit, fixed), forward, F.concat(user, F.lit("@"), host))


def listing_path(folder: Column) -> Column:
    """The root for an empty id; null for one that could be more than a path segment."""
    return F.when(folder == "", F.lit("/documents/")).when(valid_id(folder), F.concat(F.lit("/documents/"), folder))


def fetch(folders: DataFrame, origin: str, ask: Get = get) -> DataFrame:
    """(folder, body, error) of folders (folder): a failed request is an error, not an exception."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for folder, path in zip(pdf["folder"], pdf["path"]):
                try:
                    rows.append((folder, None, "bad identifier") if path is None else (folder, ask(origin + path), None))
                except OSError as e:
                    rows.append((folder, None, failure(e)))
            yield pd.DataFrame(rows, columns=["folder", "body", "error"])

    return folders.select("folder", listing_path(F.col("folder")).alias("path")).mapInPandas(read, "folder string, body string, error string")


def walk(spark: SparkSession, origin: str, ask: Get = get) -> DataFrame:
    """All items (id, name, kind, parent, file_type) below the root, at any depth.

    The folders of a level are asked in parallel and its items are written as a table. A root that can't be read and a
    folder whose id could be more than a path segment end the walk with an error; another folder that fails is skipped.
    Folders that were asked are not asked again, so a cycle in the device's answers ends.
    """
    folder = shared_folder(spark, "device")
    asked, levels = [f"{folder}/asked-0"], []
    level = written(spark.createDataFrame([("",)], "folder string"), asked[0])
    while True:
        answers = fetch(level, origin, ask).select("folder", "error", V.listing_items(F.col("body")).alias("items"))
        answers = written(answers, f"{folder}/answers-{len(levels)}")
        if not levels:
            root = answers.first()
            if root["items"] is None:
                raise OSError(root["error"] or "unreadable listing")
        levels.append(f"{folder}/items-{len(levels)}")
        items = written(answers.select(F.inline("items")), levels[-1])
        opens = items.where("kind = 'folder' and parent <> 'trash'").select(F.col("id").alias("folder")).distinct()
        unsafe = opens.where(~valid_id(F.col("folder"))).first()
        if unsafe:
            raise OSError(f"bad identifier: {unsafe['folder'][:80]}")
        level = written(opens.join(spark.read.schema("folder string").parquet(*asked), "folder", "left_anti"), f"{folder}/asked-{len(asked)}")
        asked.append(f"{folder}/asked-{len(asked)}")
        if level.isEmpty():
            return spark.read.schema(items.schema).parquet(*levels)


def download(items: DataFrame, origin: str, ask: Callable[[str], bytes] = get_bytes) -> DataFrame:
    """(id, file, content, error) of chosen items (id, name): each as a PDF under its safe name."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, file, path in zip(pdf["id"], pdf["file"], pdf["path"]):  # one item at a time in memory
                try:
                    row = (item, file, None, "bad identifier") if path is None else (item, file, ask(origin + path), None)
                except OSError as e:
                    row = (item, file, None, failure(e))
                yield pd.DataFrame([row], columns=["id", "file", "content", "error"])

    named = items.select("id", F.concat(safe_filename("name"), F.lit(".pdf")).alias("file"), V.download_path(F.col("id")).alias("path"))
    return named.mapInPandas(read, "id string, file string, content binary, error string")
