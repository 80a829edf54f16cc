"""A run that goes on by itself: answers arrive as a stream, and each page says what it holds and what to ask next.

A page's state is what was merged of the sections before the first one still waited for, and the sections that came
early. An answer is folded in once; the state grows with the page's text only. It is kept by Spark in the stream's
checkpoint, so a run that was stopped goes on where it was.

The first answer or lapse of a section counts; later ones are ignored, so a repeated file changes nothing. A section
that nothing comes for within ``patience`` lapses by a timer, and the run goes on with the next one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators import merge as M
from quire.plans import prompts as P

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "page long, total int, done int, failed int, truncated int, index int, previous string, text string, step long"
LATE = "failed: no answer"


class PageRun(StatefulProcessor):
    """One page: sections that came, in order, and those that came early."""

    def __init__(self, patience_ms: int | None = None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "index int", "section string")  # JSON of [lines, previous, lapse]
        self.page = handle.getValueState("page", "total int, upto int, failed int, truncated int, step long, previous string, merged string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.read()
        for pdf in rows:
            for index, total, text, lines, normals, blanks, lapse in pdf[["index", "total", "text", "lines", "normals", "blanks", "lapse"]].itertuples(index=False, name=None):
                state["total"] = max(state["total"], int(total))
                if index < state["upto"] or self.early.containsKey((int(index),)):
                    continue
                read = None if lines is None else [list(x) for x in zip(lines, normals, map(bool, blanks))]
                self.early.updateValue((int(index),), (json.dumps([read, text, lapse]),))
        yield from self.go_on(key, state, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.read()
        if state["upto"] < state["total"]:
            self.early.updateValue((state["upto"],), (json.dumps([None, None, LATE]),))
            yield from self.go_on(key, state, timerValues)

    def read(self) -> dict:
        if not self.page.exists():
            return {"total": 0, "upto": 0, "failed": 0, "truncated": 0, "step": 0, "previous": None, "merged": None}
        total, upto, failed, truncated, step, previous, merged = self.page.get()
        return {"total": total, "upto": upto, "failed": failed, "truncated": truncated, "step": step, "previous": previous, "merged": json.loads(merged)}

    def go_on(self, key, s: dict, timers) -> Iterator[pd.DataFrame]:
        while self.early.containsKey((s["upto"],)):
            lines, s["previous"], lapse = json.loads(self.early.getValue((s["upto"],))[0])
            self.early.removeKey((s["upto"],))
            if lines is not None:
                s["merged"] = M.joined(s["merged"], [tuple(x) for x in lines])
            s["failed"] += bool(lapse) and lapse != "truncated"
            s["truncated"] += lapse == "truncated"
            s["upto"] += 1
        s["step"] += 1
        self.page.update((s["total"], s["upto"], s["failed"], s["truncated"], s["step"], s["previous"], json.dumps(s["merged"])))
        waiting = s["upto"] < s["total"]
        if self.patience_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if waiting:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience_ms)
        ahead = sorted((index[0], json.loads(section[0])) for index, section in self.early.iterator())
        merged, failed, truncated = s["merged"] and list(s["merged"]), s["failed"], s["truncated"]
        for _, (lines, _, lapse) in ahead:
            merged = merged if lines is None else M.joined(merged, [tuple(x) for x in lines])
            failed, truncated = failed + (bool(lapse) and lapse != "truncated"), truncated + (lapse == "truncated")
        row = (int(key[0]), s["total"], s["upto"] + len(ahead), failed, truncated, s["upto"] if waiting else None, s["previous"], M.text_of(merged), s["step"])
        frame = pd.DataFrame([row], columns=["page", "total", "done", "failed", "truncated", "index", "previous", "text", "step"])
        yield frame.astype({"index": "Int32"})

    def close(self) -> None:
        pass


def follow(arrived: DataFrame, plan: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """(page, total, done, failed, truncated, index, prompt, text, step) whenever something comes for a page.

    ``arrived`` is a stream of (page, index, text, lapse), ``plan`` the table (page, total) of all pages' numbers of
    sections. ``index`` and ``prompt`` say what to ask next, null for a finished page; ``text`` is what was read so far;
    ``step`` counts a page's rows, the last of which holds.
    """
    known = M.read_lines(arrived.where("text is not null or lapse is not null").join(plan, "page"), "page", "index", "total", "text", "lapse")
    mode = "ProcessingTime" if patience_ms else "None"
    states = known.groupBy("page").transformWithStateInPandas(PageRun(patience_ms), OUT, "Update", mode)
    prompt = F.when(F.col("index").isNotNull(), P.for_section(F.col("index"), F.col("total"), F.col("previous")))
    return states.select("page", "total", "done", "failed", "truncated", "index", prompt.alias("prompt"), "text", "step")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state of several kinds needs the store on disk; other streams of the session keep theirs."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_available(spark: SparkSession, states: DataFrame, folder: str) -> None:
    """Take what has arrived since the last call and append the pages' rows as Parquet in ``folder``/out."""

    def append(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    with state_store(spark):
        states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(append).start().awaitTermination()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each page."""
    columns = ["total", "done", "failed", "truncated", "index", "prompt", "text"]
    schema = "page long, total int, done int, failed int, truncated int, index int, prompt string, text string, step long"
    rows = spark.read.schema(schema).parquet(f"{folder}/out/batch=*")
    return rows.groupBy("page").agg(F.max_by(F.struct(*columns), "step").alias("s")).select("page", "s.*")
