"""Token ids in one compressed file a shard: a wavelet matrix of bit planes with rank and select.

Documents are dealt to tasks by ranges of doc_id, whose number grows with the root of the bytes; a task cuts its range
into shards of about ``shard_bytes`` bytes of text (a longer document has a shard to itself), encodes a shard, appends the
end id to each document and writes one file: the shard's alphabet, the documents' ids and sizes, and one bit plane for
each bit of the alphabet's codes in compressed frames, with the counts of ones before every block. ``open`` reads the
tables; ``access`` gives the token at a place, ``rank`` counts a token before a place and ``select`` finds an occurrence,
each from a frame or two of every plane; ``tokens`` restores all ids.

A file is written under a name of its own attempt and then renamed, so a repeated task leaves the same file. The
folder is in the shared storage that ``spark.checkpoint.dir`` names (any file system that pyarrow knows by its URI).

Defined cases: a null or empty text has the end id only; a null doc_id comes first; rows with equal doc_ids are
ordered by their texts; other columns are ignored; an empty table gives no rows and no file.
"""

from __future__ import annotations

import io
import itertools
import json
import math
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.arrow import batched, rows_of
from quire.llm.storage import fresh_path

MAGIC = b"WVMX2\n"
BLOCK = 512  # bits between two counts of ones
FRAME = 1 << 16  # bytes of a plane that are compressed together
STRETCH = 1 << 16  # places restored at once

#: Bytes of text that a shard holds about.
SHARD_BYTES = 24 << 20

#: Words of at most LONGEST characters that a worker remembers: the first ones it sees, among which are the frequent ones.
MEMO, LONGEST = 1_000_000, 64


class Frames:
    """A plane in a file: bytes by place or slice, a frame at a time; the frame read last is kept."""

    def __init__(self, source, starts: list[int], size: int, frame: int):
        self.source, self.starts, self.size, self.frame, self.held = source, starts, size, frame, (-1, b"")

    def read(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.source.seek(self.starts[k])
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(self.starts[k + 1] - self.starts[k]))
            self.held = k, np.frombuffer(raw, np.uint8)
        return self.held[1]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, slice):
            low, high, _ = at.indices(self.size)
            parts = [self.read(k)[max(low - k * self.frame, 0) : high - k * self.frame] for k in range(low // self.frame, -(-high // self.frame))]
            return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])
        return self.read(at // self.frame)[at % self.frame]


class WaveletMatrix:
    """Over codes 0 to len(alphabet) - 1 in ``width`` planes, the highest bit first."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list, counts: list[np.ndarray] | None = None):
        self.n, self.alphabet, self.planes = n, alphabet, planes
        self.counts = counts if counts is not None else [np.concatenate([[0], np.cumsum(np.bitwise_count(np.pad(p, (0, -len(p) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64))]) for p in planes]
        self.zeros = [n - int(c[-1]) for c in self.counts]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet = np.unique(ids)
        lookup = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
        lookup[alphabet] = np.arange(len(alphabet))
        codes = lookup[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes = []
        for bit in range(cls.width_of(len(alphabet)) - 1, -1, -1):
            codes = codes.astype(np.uint8) if bit == 7 else codes
            ones = (codes & codes.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            if bit:
                codes = np.concatenate([codes.compress(~ones), codes.compress(ones)])
        return cls(len(ids), alphabet.astype(np.uint32), planes)

    @staticmethod
    def width_of(size: int) -> int:
        return max(1, (max(size, 1) - 1).bit_length())

    def bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at >> 3]) >> (at & 7) & 1

    def ones(self, plane: int, at: int) -> int:
        """Ones before ``at``."""
        block = at // BLOCK
        part = self.planes[plane][block * BLOCK // 8 : at >> 3]
        rest = int(self.planes[plane][at >> 3]) & ((1 << (at & 7)) - 1) if at & 7 else 0
        return int(self.counts[plane][block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, at: int) -> int:
        code = 0
        for p in range(len(self.planes)):
            one = self.bit(p, at)
            code = code << 1 | one
            at = self.zeros[p] + self.ones(p, at) if one else at - self.ones(p, at)
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` before ``at``."""
        code = self._code(token)
        if code is None:
            return 0
        low, width = 0, len(self.planes)
        for p in range(width):
            a, b = self.ones(p, low), self.ones(p, at)
            low, at = (self.zeros[p] + a, self.zeros[p] + b) if code >> (width - 1 - p) & 1 else (low - a, at - b)
        return at - low

    def nth_bit(self, plane: int, one: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) bit of a plane that is ``one``, which there must be."""
        counts = self.counts[plane]
        low, high = 0, len(counts) - 1  # the last block with at most ``nth`` such bits before it
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if (int(counts[mid]) if one else mid * BLOCK - int(counts[mid])) <= nth else (low, mid)
        before = int(counts[low]) if one else low * BLOCK - int(counts[low])
        bits = np.unpackbits(self.planes[plane][low * BLOCK // 8 : (low + 1) * BLOCK // 8], bitorder="little")
        return low * BLOCK + int(np.flatnonzero(bits == one)[nth - before])

    def select(self, token: int, nth: int) -> int:
        """Place of occurrence ``nth`` (from 0) of ``token``; -1 if there are fewer. From the top plane down to where the
        token's code is sorted to, and back up by the places of the same bits."""
        code, width = self._code(token), len(self.planes)
        if code is None or nth >= self.rank(token, self.n):
            return -1
        at, bits = 0, [code >> (width - 1 - p) & 1 for p in range(width)]
        for p, one in enumerate(bits):
            at = self.zeros[p] + self.ones(p, at) if one else at - self.ones(p, at)
        at += nth
        for p in range(width - 1, -1, -1):
            at = self.nth_bit(p, bits[p], at - self.zeros[p] if bits[p] else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, restored from the last plane to the first."""
        out, wide = np.zeros(self.n, np.uint8), np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        for k, plane in enumerate(reversed(self.planes)):
            out = out.astype(wide) if k == 8 else out
            ones = np.unpackbits(plane[:], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(out)
            low, high = 0, self.n - np.count_nonzero(ones)
            for at in range(0, self.n, STRETCH):  # both sides advance in order, so a stretch stays in the cache
                part, here = ones[at : at + STRETCH], before[at : at + STRETCH]
                zero, one = np.flatnonzero(~part), np.flatnonzero(part)
                here[zero] = out[low : low + len(zero)]
                here[one] = out[high : high + len(one)] | out.dtype.type(1 << k)
                low, high = low + len(zero), high + len(one)
            out = before
        return self.alphabet[out] if self.n else np.zeros(0, np.uint32)

    def dump(self, doc_ids: list[int | None], sizes: np.ndarray, frame: int = FRAME) -> bytes:
        """The file: a line of JSON, then the zstd-compressed tables and the frames of the planes it lists."""
        known = np.array([d is not None for d in doc_ids], np.uint8)
        tables = [known, np.array([d or 0 for d in doc_ids], "<i8"), np.asarray(sizes, "<i8"), self.alphabet.astype("<u4"), *(c.astype("<u4") for c in self.counts)]
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(t.tobytes()) for t in tables] + [pack(p[k : k + frame].tobytes()) for p in self.planes for k in range(0, len(p), frame)]
        head = json.dumps({"n": self.n, "docs": len(doc_ids), "planes": len(self.planes), "frame": frame, "sizes": [len(p) for p in parts]}).encode()
        return MAGIC + head + b"\n" + b"".join(parts)

    @classmethod
    def open(cls, source) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        """(matrix, doc_ids, sizes) of a file that can be read at any place; of the planes nothing is read yet."""
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        head = b""
        while b"\n" not in head:
            head += source.read(1 << 16)
        told = json.loads(head[: head.index(b"\n")])
        n, planes, frame = told["n"], told["planes"], told["frame"]
        cuts = np.cumsum([len(MAGIC) + head.index(b"\n") + 1, *told["sizes"]]).tolist()
        tables = 4 + planes
        source.seek(cuts[0])
        raw = source.read(cuts[tables] - cuts[0])
        known, ids, sizes, alphabet, *counts = [zstandard.ZstdDecompressor().decompress(raw[a - cuts[0] : b - cuts[0]]) for a, b in itertools.pairwise(cuts[: tables + 1])]
        docs = [d if k else None for d, k in zip(np.frombuffer(ids, "<i8").tolist(), known)]
        per = -(-((n + 7) // 8) // frame)
        kept = [Frames(source, cuts[tables + p * per : tables + (p + 1) * per + 1], (n + 7) // 8, frame) for p in range(planes)]
        return cls(n, np.frombuffer(alphabet, "<u4"), kept, [np.frombuffer(c, "<u4") for c in counts]), docs, np.frombuffer(sizes, "<i8")

    @classmethod
    def load(cls, blob: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        return cls.open(io.BytesIO(blob))


# The steps before the model of the tokenizer files that words may be encoded for one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def encodes_words_alone(path: str) -> bool:
    """Whether a tokenizer file has these steps, so that text between white space is encoded by itself."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = (told.get("normalizer") or {}).get("normalizers"), (told.get("pre_tokenizer") or {}).get("pretokenizers")
    return steps == (NORMALIZERS, PRE_TOKENIZERS) and not told["model"].get("dropout") and not told.get("truncation") and not told.get("padding")


class WordEncoder:
    """Ids by the tokenizers library for a vocabulary of words.

    Its pre-tokens never hold white space and are encoded one by one, so each distinct string between white space is
    cut into pre-tokens and encoded by the library's model once, and remembered. Texts with characters beyond ASCII
    and the letters and signs of Latin-1, or with added tokens, are encoded by the library as a whole, and so are all texts
    if the file has other steps than these.
    """

    #: Letters of Latin-1, lower-cased, and its numbers; fixed values.
    LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.known = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa1-\xac\xae-\xff]*" if encodes_words_alone(path) else r"(?!)")
        self.pieces = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{self.LETTERS}]+|[{self.NUMBERS}]|[^{self.LETTERS}{self.NUMBERS}]+")
        self.added = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.levels = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.ids = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab().values()) + 1)]
        self.memo = Memo(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.memo.get(piece)
        if ids is None:
            found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.levels))
            ids = self.memo.keep(piece, b"".join([self.ids[t.id] for t in found]))
        return ids

    def word(self, word: str) -> bytes:
        """A single pre-token is remembered as itself, so that ``word,`` finds ``word``."""
        return self.piece(word) if word.isascii() and word.isalpha() else self.memo.keep(word, b"".join(map(self.piece, self.pieces.findall(word))))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.known.fullmatch(text) or self.added.search(text):
            return self.whole(text)
        return b"".join(map(self.memo.__getitem__, text.lower().split()))


class Memo(dict):
    """Ids of words; those that aren't there yet are made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        return self.make(word)

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self) < MEMO and len(word) <= LONGEST:
            self[word] = ids
        return ids


_encoders: dict[str, WordEncoder] = {}


def write_file(folder: str, name: str, blob: bytes) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(blob)
    fs.move(part, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES, spread: int = 500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files; (part, seq, docs, n_tokens) of each, in ascending doc_id order by part and seq.

    There are about root(bytes) / ``spread`` parts: 48 at 0.56 GB, 20,000 at 100 TB. A part's rows are streamed, and one
    shard of it is in memory at a time.
    """
    plain = docs.selectExpr(f"cast({doc_id} as bigint) as doc_id", f"coalesce(cast({text} as string), '') as text")
    total = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(math.sqrt(total) / spread))
    dealt = plain.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "tie", "text")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("n_tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordEncoder(tokenizer))

        def flush(part, seq, keys, ids):
            sizes = np.array([len(x) // 4 for x in ids])
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
            ids.clear()
            write_file(folder, f"shard-{part:06d}-{seq:06d}.wvm", matrix.dump(keys, sizes))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, seq, len(keys), matrix.n), schema)], schema=schema)

        seq, size, keys, ids = 0, 0, [], []
        for batch in batches:
            for part, key, body in rows_of(batch, "part", "doc_id", "text"):
                if size and size + len(body) > shard_bytes:
                    yield flush(part, seq, keys, ids)
                    seq, size, keys, ids = seq + 1, 0, [], []
                keys.append(key)
                ids.append(encoder.encode(body) + end)
                size += len(body)
        if keys:
            yield flush(part, seq, keys, ids)

    return dealt.select("part", "doc_id", "text").mapInArrow(write, "part int, seq int, docs long, n_tokens long")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, seq, place) of every document, from the files."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        def rows():
            for batch in batches:
                for name, blob in rows_of(batch, "path", "content", step=1):
                    matrix, docs, sizes = WaveletMatrix.load(blob)
                    ids, at = matrix.tokens().astype("<u4"), 0
                    part, seq = map(int, re.search(r"shard-(\d+)-(\d+)\.wvm", name).groups())
                    for doc, size in zip(docs, sizes.tolist()):
                        yield part, seq, doc, at, size, zlib.crc32(ids[at : at + size])
                        at += size

        yield from batched(rows(), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wvm").load(folder).select("path", "content")
    found = files.mapInArrow(read, "part int, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")
    # One row a file within its part, and one row a part: 20,000 at 100 TB.
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = manifest.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("inside"))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", earlier(Window.orderBy("part")).alias("before"))
    placed = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("before"))
    return found.join(placed, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "place")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES, spread: int = 500) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from files written in the shared folder."""
    spark = docs.sparkSession
    folder, at = fresh_path(spark, "wavelets"), fresh_path(spark, "manifest")
    write_shards(docs, folder, tokenizer, end_id, shard_bytes, spread).write.parquet(at)
    manifest = spark.read.schema("part int, seq int, docs long, n_tokens long").parquet(at)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
