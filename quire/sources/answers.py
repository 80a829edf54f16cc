"""Where answers come from: a recorded table, or a live model asked section by section."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.wire import server_model, server_vision
from quire.sources.device import failure, get

TIMEOUT_S = 300

#: (text, truncated, lapse) of one request's body.
Ask = Callable[[str], tuple[str | None, bool, str | None]]


def http(url: str, timeout: int = TIMEOUT_S) -> Ask:
    """Ask a chat-completions server; a failure is a lapse with its message, never an exception."""

    def ask(body: str) -> tuple[str | None, bool, str | None]:
        request = urllib.request.Request(f"{url.rstrip('/')}/v1/chat/completions", body.encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                choice = json.load(r)["choices"][0]
            return choice["message"]["content"], choice.get("finish_reason") == "length", None
        except urllib.error.HTTPError as e:
            return None, False, f"failed: {failure(e)} {e.read(300).decode(errors='replace')}"
        except OSError as e:
            return None, False, f"failed: {failure(e)}"
        except (ValueError, LookupError, TypeError) as e:
            return None, False, f"failed: {e}"

    return ask


def probe(spark: SparkSession, url: str, ask: Callable[[str], str] = get) -> DataFrame:
    """(model, vision, error) of a server, asked once: one row, with an error where it can't be asked."""
    try:
        body, error = ask(f"{url.rstrip('/')}/props"), None
    except OSError as e:
        body, error = None, failure(e)
    told = spark.createDataFrame([(body, error)], "body string, error string")
    return told.select(server_model(F.col("body")).alias("model"), server_vision(F.col("body")).alias("vision"), "error")


def live(sections: DataFrame, ask: Ask, prompt: Callable[[int, int, str | None], str], request: Callable[[str, str], str]) -> DataFrame:
    """(page, index, text, lapse) for sections (page, index, total, url).

    A section's prompt holds the end of the answer above, so one page is asked in order; pages are independent and
    run in parallel. A lapse doesn't stop its page.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, previous = [], None
        for page, index, total, url in pdf.sort_values("index")[["page", "index", "total", "url"]].itertuples(index=False, name=None):
            text, truncated, lapse = ask(request(prompt(index, total, previous), url))
            out.append((page, index, text, lapse or ("truncated" if truncated else None)))
            previous = text
        return pd.DataFrame(out, columns=["page", "index", "text", "lapse"])

    return sections.select("page", "index", "total", "url").groupBy("page").applyInPandas(run, "page long, index int, text string, lapse string")
