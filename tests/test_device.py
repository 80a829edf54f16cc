"""Walking a device whose listings are served on the loopback address."""

from __future__ import annotations

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quire.sources import device as D

LISTINGS = {
    "/documents/": [{"ID": "f", "VissibleName": "F", "Type": "CollectionType"}, {"ID": "d", "VisibleName": "D", "fileType": "notebook"}, {"ID": "t", "Type": "CollectionType", "Parent": "trash"}],
    "/documents/f": [{"ID": "g", "VissibleName": "G", "Type": "CollectionType", "Parent": "f"}, {"ID": "f", "VissibleName": "again", "Type": "CollectionType", "Parent": "f"}],
    "/documents/t": [{"ID": "hidden"}],
}


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = LISTINGS.get(self.path)
        self.send_response(200 if body is not None else 404)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def origin():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield D.tunnel_origin(server.server_port)
    server.shutdown()


def test_walk(spark, origin):
    got = D.walk(spark, origin)
    assert sorted(r.id for r in got.collect()) == ["d", "f", "f", "g", "t"]
    errors = {r.folder: r.error for r in D.fetch(spark.createDataFrame([("",), ("g",), ("../x",)], "folder string"), origin).collect()}
    assert errors == {"": None, "g": "transport: 404", "../x": "bad identifier"}


def test_unsafe_folder_ends_the_walk(spark):
    items = {"o/documents/": [{"ID": "f", "Type": "CollectionType"}], "o/documents/f": [{"ID": "../x", "Type": "CollectionType"}]}
    with pytest.raises(OSError, match="bad identifier"):
        D.walk(spark, "o", lambda url: json.dumps(items[url]))


def test_deep_walk(spark):
    def ask(url):
        k = int(url.rsplit("/", 1)[1] or 0)
        return json.dumps([{"ID": str(k + 1), "Type": "CollectionType"}] if k < 40 else [])

    assert D.walk(spark, "o", ask).count() == 40


def test_download(spark):
    items = spark.createDataFrame([("a", "My/notes"), ("../b", "x"), ("c", "gone")], "id string, name string")

    def ask(url):
        if url.endswith("/c/placeholder"):
            raise OSError("asleep")
        return b"%PDF-" + url.encode()

    got = {r.id: (r.file, r.content and bytes(r.content), r.error) for r in D.download(items, "o", ask).collect()}
    assert got["a"] == ("My-notes.pdf", b"%PDF-o/download/a/placeholder", None)
    assert got["../b"][1:] == (None, "bad identifier") and got["c"][2] == "unreachable: asleep"


def test_unreachable_root(spark):
    with pytest.raises(OSError, match="unreachable"):
        D.walk(spark, "http://127.0.0.1:9")


def test_tunnel_command(spark):
    argv = spark.range(1).select(D.tunnel_command(F.lit("h; rm"), F.lit("root"), F.lit(8080))).first()[0]
    assert argv[-1] == "root@h; rm" and argv[-2] == "127.0.0.1:8080:127.0.0.1:80" and argv[0] == "ssh"
