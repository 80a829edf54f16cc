"""Byte-level BPE encoding and decoding with overlapping chunks.

A text becomes chunks of ``chunk`` code points that overlap the next one. Chunks are pre-tokenised in parallel. Scanning
from any position, the pre-tokens soon fall into step with those of the text; from the first boundary that two
neighbouring chunks share in their overlap on, both scans are equal, since the pattern looks ahead by one character only
and never behind. Each chunk is cut at these shared boundaries, the pieces are encoded in parallel, and digests run over
a document's pieces in order. Chunks without a shared boundary in their overlap (such as one run of letters longer than
it) are joined into one piece, which is exact at any length. Decoding concatenates the raw bytes of the ids.

A text of at most ``chunk`` code points is one chunk and one piece. It takes the same steps (``chunk_rows``,
``piece_rows``, ``digest_rows``) in the task that read it, as there is no neighbour to meet over a shuffle.

Defined cases: a null text is empty (no ids); doc_id may be null or repeated, each row is encoded; characters that
the pre-tokeniser's library may class differently never decide a boundary; a very long text is spread over the cluster
by its chunks; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrow import batched, rows_of
from quire.llm.pretokens import doubtful, pattern
from quire.llm.storage import materialize

CHUNK, OVERLAP = 32_768, 512

RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The library's encoding by a file of ranks, made once a worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encode(text: str, path: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(encoding(path).encode_ordinary(text), "<u4").tobytes()


def decode(ids: bytes, path: str) -> bytes:
    return encoding(path).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def boundaries(text: str, start: int, stop: int) -> list[int]:
    """Starts of pre-tokens within [start, stop) of a scan from 0 that do not follow white space.

    Those after white space are left out, as the pattern looks ahead there and a piece must not end so; and so are
    those beyond a doubtful character, and the last match, which the end of the chunk may have cut short."""
    bad = doubtful().search(text, start) if not text.isascii() else None
    stop = min(stop, bad.start() if bad else stop)
    found = []
    for m in pattern().finditer(text):
        if m.start() >= stop:
            break
        if m.start() >= start and m.end() + 1 < len(text) and not (m.start() and text[m.start() - 1].isspace()):
            found.append(m.start())
    return found


CHUNKS = "row_key long, doc_id long, k int, n int, body string"


def chunk_rows(batches, chunk: int, overlap: int):
    """(row_key, doc_id, k, n, body): chunk k of n holds code points k*chunk to (k+1)*chunk+overlap."""
    for batch in batches:
        for key, doc, text in rows_of(batch, "row_key", "doc_id", "text", step=64):
            n = max(1, -(-len(text) // chunk))
            for k in range(n):
                yield key, doc, k, n, text[k * chunk : (k + 1) * chunk + (overlap if k + 1 < n else 0)]


def split_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("body", pa.string())])
    return docs.mapInArrow(lambda batches: batched(chunk_rows(batches, chunk, overlap), schema, max_rows=256), CHUNKS)


def chunk_boundaries(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row_key, k, head, tail): boundaries in the overlaps with the chunk before and after, from the chunk's scan.

    ``tail`` counts from the next chunk's start, as that chunk's ``head`` does.
    """

    def scan(batches):
        schema = pa.schema([("row_key", pa.int64()), ("k", pa.int32()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])

        def rows():
            for batch in batches:
                for key, k, body in rows_of(batch, "row_key", "k", "body", step=16):
                    head = [] if k == 0 else boundaries(body[: 4 * overlap], 0, overlap)
                    tail = [p - chunk for p in boundaries(body, chunk, len(body))] if len(body) > chunk else []
                    yield key, k, head, tail

        yield from batched(rows(), schema)

    return chunks.select("row_key", "k", "body").mapInArrow(scan, "row_key long, k int, head array<int>, tail array<int>")


def stitch(bounds: DataFrame) -> DataFrame:
    """(row_key, k, cut, next_cut, piece): where chunk k starts within itself (null: it goes on from the chunk
    before) and where the next one starts within that. Behind a chunk without a cut nothing is proven to be in step."""
    before = bounds.select("row_key", (F.col("k") + 1).alias("k"), F.col("tail").alias("tail_before"))
    cut = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail_before")))
    by_doc = Window.partitionBy("row_key").orderBy("k")  # one small row a chunk of one document
    cuts = bounds.select("row_key", "k", "head").join(before, ["row_key", "k"], "left").select("row_key", "k", cut.alias("own"))
    cuts = cuts.select("row_key", "k", F.when(F.min(F.col("own").isNotNull()).over(by_doc), F.col("own")).alias("cut"))
    return cuts.select("row_key", "k", "cut", F.lead("cut").over(by_doc).alias("next_cut"), F.sum(F.col("cut").isNotNull().cast("int")).over(by_doc).alias("piece"))


def piece_rows(rows, path: str, chunk: int):
    """(row_key, doc_id, piece, ids) of (row_key, doc_id, piece, k, n, cut, next_cut, body), where the chunks of one piece
    follow each other."""
    held, texts = None, []
    for key, doc, piece, k, n, cut, after, body in rows:
        if held is not None and held != (key, doc, piece):
            yield *held, encode("".join(texts), path)
            texts = []
        held = (key, doc, piece)
        # A chunk that goes on from the one before starts at 0; one that the next goes on from ends at its size.
        texts.append(body[cut or 0 : len(body) if k + 1 == n else chunk + (after or 0)])
    if held is not None:
        yield *held, encode("".join(texts), path)


def digest_rows(pieces, path: str):
    """Digests over each document's pieces (row_key, doc_id, ids) in order, one piece in memory at a time."""
    held = None
    for key, doc, ids in pieces:
        if held is None or held[0] != key:
            if held is not None:
                yield held[1], held[2], held[3].hexdigest(), held[4].hexdigest()
            held = [key, doc, 0, hashlib.sha256(), hashlib.sha256()]
        held[2] += len(ids) // 4
        held[3].update(ids)
        held[4].update(decode(ids, path))
    if held is not None:
        yield held[1], held[2], held[3].hexdigest(), held[4].hexdigest()


def encode_in_place(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """All steps in one task, for texts of one chunk: it starts at its own beginning and nothing follows it."""

    def steps(batches):
        alone = ((key, doc, 1, k, n, 0, None, body) for key, doc, k, n, body in chunk_rows(batches, chunk, overlap))
        yield from batched(digest_rows(((key, doc, ids) for key, doc, _, ids in piece_rows(alone, path, chunk)), path), RESULT)

    return docs.mapInArrow(steps, RESULT_DDL)


def encode_pieces(chunks: DataFrame, cuts: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row_key, doc_id, piece, ids): chunks of one piece are neighbours after the shuffle."""
    names = ("row_key", "doc_id", "piece", "k", "n", "cut", "next_cut", "body")
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary())])

    def pieces(batches):
        rows = (row for batch in batches for row in rows_of(batch, *names, step=16))
        yield from batched(piece_rows(rows, path, chunk), schema, max_rows=64)

    cut = chunks.join(cuts, ["row_key", "k"])
    return cut.repartition("row_key", "piece").sortWithinPartitions("row_key", "piece", "k").mapInArrow(pieces, "row_key long, doc_id long, piece int, ids binary")


def digest_pieces(pieces: DataFrame, path: str) -> DataFrame:
    def digests(batches):
        yield from batched(digest_rows((row for batch in batches for row in rows_of(batch, "row_key", "doc_id", "ids", step=16)), path), RESULT)

    return pieces.repartition("row_key").sortWithinPartitions("row_key", "piece").mapInArrow(digests, RESULT_DDL)


def encode_decode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's text."""
    plain = docs.selectExpr(f"cast({doc_id} as bigint) as doc_id", f"coalesce(cast({text} as string), '') as text").withColumn("row_key", F.monotonically_increasing_id())
    several = F.length("text") > chunk
    chunks = materialize(split_chunks(plain.where(several), chunk, overlap).repartition("row_key", "k"), "chunks")
    cuts = stitch(materialize(chunk_boundaries(chunks, chunk, overlap), "boundaries"))
    return encode_in_place(plain.where(~several), path, chunk, overlap).unionAll(digest_pieces(encode_pieces(chunks, cuts, path, chunk), path))
