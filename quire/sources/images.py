"""Pages as images: brightness profiles, crops, and PDF pages."""

from __future__ import annotations

import struct
import subprocess
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.layout import budget_size
from quire.functions.wire import is_pdf

PNG_END = b"IEND\xaeB`\x82"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, channels, data) of the images that can be decoded and aren't empty."""
    i = F.col("image")
    df = spark.read.format("image").option("dropInvalid", True).load(path)
    return df.select(i["origin"].alias("origin"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("data")).where("width > 0 and height > 0")


def brightness(data: bytes, width: int, height: int, channels: int) -> list[int]:
    """Whole mean of each row over three colours; transparent pixels count as white by their share, gray as three."""
    pixels = np.frombuffer(data, np.uint8, count=width * height * channels).reshape(height, width, channels).astype(np.int64)
    ink = pixels[:, :, 0] * 3 if channels < 3 else pixels[:, :, :3].sum(axis=2)
    if channels == 4:
        alpha = pixels[:, :, 3]
        ink = (ink * alpha + 3 * 255 * (255 - alpha)) // 255
    return (ink.sum(axis=1) // (3 * width)).tolist()


def profile(data: Column, width: Column, height: Column, channels: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def rows(d: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([brightness(*x) for x in zip(d, w, h, c)], dtype=object)

    return rows(data, width, height, channels)


def profile_rows(images: DataFrame, key: str) -> DataFrame:
    """(key, row, brightness): the pixels are left behind before anything is shuffled."""
    shaped = images.where("width > 0 and height > 0").select(key, profile(F.col("data"), F.col("width"), F.col("height"), F.col("channels")).alias("_rows"))
    return shaped.select(key, F.posexplode("_rows").alias("row", "brightness"))


def crop(data: Column, width: Column, height: Column, channels: Column, top: Column, bottom: Column) -> Column:
    """The rows from ``top`` to ``bottom`` as raw pixels, clamped to the page; null if there is none."""
    lo, hi = F.least(top, height), F.least(bottom, height)
    return F.when(hi > lo, F.substring(data, lo * width * channels + 1, (hi - lo) * width * channels))


def shrunk(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels (rows, columns, channels) by the mean of the area that each new one covers, so thin strokes stay."""
    for axis, size in ((0, height), (1, width)):
        edges = np.linspace(0, pixels.shape[axis], size + 1)
        sums = np.concatenate([np.zeros_like(pixels.take([0], axis), np.float64), np.cumsum(pixels, axis=axis, dtype=np.float64)], axis=axis)
        whole, rest = np.floor(edges).astype(int), edges - np.floor(edges)
        part = rest.reshape([-1 if k == axis else 1 for k in range(3)]) * pixels.take(np.minimum(whole, pixels.shape[axis] - 1), axis)
        pixels = np.diff(sums.take(whole, axis) + part, axis=axis) / np.diff(edges).reshape([-1 if k == axis else 1 for k in range(3)])
    return np.clip(np.rint(pixels), 0, 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of gray, gray with alpha, RGB or RGBA pixels."""
    height, width, channels = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def section_png(images: DataFrame) -> DataFrame:
    """Add ``png`` and ``error`` to (data, width, height, channels, top, bottom): the section's rows, scaled into the
    pixel budget, as a file. A section without rows is an error."""
    cut = crop(F.col("data"), F.col("width"), F.col("height"), F.col("channels"), F.col("top"), F.col("bottom"))
    rows = F.least("bottom", "height") - F.least("top", "height")
    fit = budget_size(F.col("width"), rows)

    @F.pandas_udf("binary")
    def encoded(data: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series, fw: pd.Series, fh: pd.Series) -> pd.Series:
        def one(d, w, h, c, fw, fh):
            if d is None:
                return None
            pixels = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))
            return png(pixels if (fw, fh) == (w, h) else shrunk(pixels, int(fw), int(fh)))

        return pd.Series([one(*x) for x in zip(data, w, h, c, fw, fh)], dtype=object)

    made = images.withColumn("png", encoded(cut, "width", rows, "channels", fit["width"], fit["height"]))
    return made.withColumn("error", F.when(F.col("png").isNull(), F.lit("section covers no rows")))


def pdf_pages(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(path, page_no, png, error) of every page of every PDF, by ``pdftoppm`` where it is installed.

    The tool reads the file from its input and writes all pages to its output, so no scratch folder is needed. A file
    that isn't a PDF, can't be rendered or has no pages gives one row with an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", is_pdf(F.col("content")).alias("pdf"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "page_no", "png", "error"])
        for pdf in batches:
            for name, content, known in zip(pdf["path"], pdf["content"], pdf["pdf"]):  # one file's pages in memory at a time
                if not known:
                    yield frame([(name, 0, None, "not a PDF")])
                    continue
                try:
                    done = subprocess.run(["pdftoppm", "-png", "-scale-to-x", str(width), "-scale-to-y", "-1", "-"], input=content, capture_output=True, timeout=600)
                except (OSError, subprocess.TimeoutExpired) as e:
                    yield frame([(name, 0, None, f"pdftoppm: {e}")])
                    continue
                pages = [x + PNG_END for x in done.stdout.split(PNG_END) if x]
                yield frame([(name, k + 1, p, None) for k, p in enumerate(pages)] or [(name, 0, None, done.stderr.decode(errors="replace") or "no pages")])

    return files.mapInPandas(render, "path string, page_no int, png binary, error string")
