"""The sink with a commit, and listings as a source and as a stream."""

from __future__ import annotations

import http.server
import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.functions import wire as V
from quire.plans import catalog
from quire.plans import render as RE
from quire.sources import listings as L
from quire.sources import transcripts as T


def rows_of(spark, folder):
    return sorted(tuple(r) for r in T.load(spark, folder).collect())


def test_saved_and_read(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("a/b "), (F.col("id") % 3).cast("string")).alias("name"), F.concat(F.lit("é text\n"), F.col("id").cast("string")).alias("body")).repartition(4)
    want = sorted((i, f"a-b {i % 3}", f"é text\n{i}") for i in range(50))
    T.save(docs, folder)
    assert rows_of(spark, folder) == want
    T.save(docs.where("doc_id < 2"), folder)
    assert rows_of(spark, folder) == sorted(want + want[:2])
    T.save(docs.where("doc_id < 2"), folder, "overwrite")
    assert rows_of(spark, folder) == want[:2] and len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("run-")]) == 1
    T.save(docs.limit(0), folder)
    assert rows_of(spark, folder) == want[:2]
    assert T.load(spark, f"file://{tmp_path}/nothing").count() == 0


def test_a_job_that_dies_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    good = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("n").alias("name"), F.lit("text").alias("body")).repartition(4)
    T.save(good.where("doc_id < 3"), folder)
    dies = good.withColumn("body", F.when(F.col("doc_id") == 17, F.raise_error(F.lit("dies"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="dies"):
        T.save(dies, folder, "overwrite")
    assert [r[0] for r in rows_of(spark, folder)] == [0, 1, 2]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("run-")]) == 1, "the folder of the job that died is gone"


def test_files_without_a_commit_are_not_seen(spark, tmp_path):
    """What a driver that died half way leaves: a folder of a job, and no manifest of it."""
    writer = T.Writer(f"file://{tmp_path}/out", False)
    first = writer.write(iter([{"doc_id": 1, "name": "n", "body": "x"}]))
    again = writer.write(iter([{"doc_id": 1, "name": "n", "body": "x"}]))
    assert rows_of(spark, f"file://{tmp_path}/out") == []
    writer.commit([again, None])
    assert rows_of(spark, f"file://{tmp_path}/out") == [(1, "n", "x")] and first.attempt != again.attempt


def test_a_task_that_goes_on_after_the_abort_adds_nothing(tmp_path):
    writer = T.Writer(f"file://{tmp_path}/run-of-tests/out", False)

    def rows():
        yield {"doc_id": 1, "name": "n", "body": "x"}
        writer.abort([])
        yield {"doc_id": 2, "name": "n", "body": "x"}

    with pytest.raises(OSError):
        writer.write(rows())
    with pytest.raises(OSError):
        writer.write(iter([]))
    assert list((tmp_path / "run-of-tests" / "out").iterdir()) == []


def test_odd_names_and_repeated_rows(spark, tmp_path):
    rows = [(1, "n", "a"), (1, "n", "a"), (1, "n", "b"), (None, "n", "c"), (2, "x" * 255, "d"), (3, "x" * 255, ""), (4, "é", None), (12, "3-n", "e"), (-1, "2-3-n", "\u2028\n")]
    T.save(spark.createDataFrame(rows, "doc_id long, name string, body string").coalesce(1), f"file://{tmp_path}/out")
    got = T.load(spark, f"file://{tmp_path}/out").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((a, b, c or "")) for a, b, c in rows)


def test_saved_documents_are_not_listed_by_the_driver(spark):
    """Folders of files grew with the documents, and the driver held the status of each file."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    saved = catalog.QUERIES["saved_documents"](spark, "/root/testdata/sf0.001")
    assert saved.inputFiles() == [] and saved.rdd.getNumPartitions() < 10
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    newest = max(root.glob("saved-*"), key=lambda p: p.stat().st_mtime_ns)
    files = list(newest.rglob("*.md"))
    assert len(files) == docs.count() == saved.count() and len({p.parent for p in files}) < 10
    want = RE.paged(docs).select("doc_id", F.concat("source", F.lit(".md")).alias("name"), RE.markdown().alias("body"))
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture
def device():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            name = self.path.rpartition("/")[2]
            self.send_response(500 if name == "broken" else 200)
            self.end_headers()
            if name != "broken":
                self.wfile.write(json.dumps([{"ID": f"{name or 'root'}-{k}", "VissibleName": f"n{k}", "Type": "DocumentType", "Parent": name, "fileType": "pdf"} for k in range(2)]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_folders_are_partitions_and_fail_alone(spark, device):
    origin, asked = device
    df = L.listings(spark, origin, ["", "one", "broken", "../etc"])
    assert df.rdd.getNumPartitions() == 4
    got = {r.folder: r for r in df.collect()}
    assert got["broken"].error == "transport: 500" and got["../etc"].error == "bad identifier" and got["broken"].body is None
    items = df.where("error is null").select(F.inline(V.listing_items(F.col("body"))))
    assert sorted(r.id for r in items.collect()) == ["one-0", "one-1", "root-0", "root-1"]
    assert not any("etc" in p for p in asked)


def test_a_filter_does_not_stay(spark, device):
    df = L.listings(spark, device[0], ["", "one"])
    assert [r.folder for r in df.where("folder = 'one'").collect()] == ["one"] and df.count() == 2


def test_a_stream_of_listings(spark, device, tmp_path):
    origin, asked = device
    L.register(spark)
    stream = spark.readStream.format("listings").option("origin", origin).option("folders", ",one").load()
    query = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").format("parquet").option("path", f"file://{tmp_path}/out").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            query.awaitTermination(1)
            if len(asked) >= 4:
                break
    finally:
        query.stop()
    got = spark.read.parquet(f"file://{tmp_path}/out").groupBy("folder").count().collect()
    assert {r.folder for r in got} == {"", "one"} and len(asked) >= 4
