"""The operators that SQL can't express, against plain versions of what they compute."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import adaptive_quality, bpe_chunks, poly_hash, simhash_bk, token_counts, wavelet

ODD = [
    "", None, " ", "a", "a\n\nb", "don't  we'll\t\tit's", "x" * 3000, "ab " * 4000, "été ça ß ÀÉ    x", "日本語 テキスト 12３4", "😀 emoji 👩‍👩‍👧 ͸ ᲊ",
    "<|endoftext|>a<|endoftext|><|startoftext|> b", "a\x1c \x1f b\x0b\x0c", "é éç İstanbul ΣΑΣ", "one two three four five six seven", "one two three four five six seven",
    "  lead and trail  ", "\n" * 700 + "x", "word " * 9 + "\r\n" * 300 + "tail of the text with spaces   " * 60, "1 2 33 444 ½ ² x²", "snake_case __init__ a_b",
]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = real + [(1000 + i, t, None if i % 3 else "en", None if i % 2 else "src0") for i, t in enumerate(ODD)] + [(None, "no id at all", None, None), (3, "same id", "en", "src0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", F.lit("clash")).withColumn("fp", F.lit(1)).repartition(3).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def key(x):
    return tuple((v is not None, v) for v in x)


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()]
    want = [(d, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for d, x in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_whole_tokens_are_proven():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = token_counts.prove_whole(path)
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole


def test_wavelet_files(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.write_and_read(docs, path, 2, shard_bytes=40_000, spread=100).collect()]
    want = {}
    for d, x in rows:
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert sorted(((d, n, c) for d, _, n, c in got), key=key) == sorted(((d, *x) for d, xs in want.items() for x in xs), key=key)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    by_start = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert by_start == sorted(by_start, key=lambda d: (d is not None, d))
    assert wavelet.write_and_read(empty, path, 2).count() == 0


def test_wavelet_matrix():
    import numpy as np

    ids = np.random.default_rng(5).integers(0, 300, 5000).astype(np.uint32) ** 2
    blob = wavelet.WaveletMatrix.build(ids).dump([1, None], np.array([4000, 1000]), frame=64)
    m, docs, sizes = wavelet.WaveletMatrix.load(blob)
    assert (m.tokens() == ids).all() and docs == [1, None] and sizes.tolist() == [4000, 1000]
    for at in (0, 1, 511, 512, 513, 4999):
        assert m.access(at) == ids[at]
        token = int(ids[at])
        assert m.rank(token, at) == int((ids[:at] == token).sum())
        nth = m.rank(token, at)
        assert m.select(token, nth) == at
    for token in set(ids[:40].tolist()):
        assert [m.select(token, k) for k in range(m.rank(token, 5000))] == np.flatnonzero(ids == token).tolist()
    assert m.rank(7, 5000) == 0 and m.select(int(ids[0]), 10**6) == -1 and m.select(7, 0) == -1

    class Counted(io.BytesIO):
        count = 0

        def read(self, size=-1):
            self.count += size
            return super().read(size)

    big = np.random.default_rng(6).integers(0, 40_000, 400_000).astype(np.uint32)
    blob = wavelet.WaveletMatrix.build(big).dump([1], np.array([len(big)]), frame=1024)
    source = Counted(blob)
    opened = wavelet.WaveletMatrix.open(source)[0]
    before = source.count
    assert opened.access(200_000) == big[200_000] and opened.rank(int(big[9]), 300_000) == int((big[:300_000] == big[9]).sum())
    assert source.count - before < len(blob) // 10, "a query reads a few frames of the planes only"
    empty_matrix = wavelet.WaveletMatrix.load(wavelet.WaveletMatrix.build(ids[:0]).dump([], np.zeros(0, np.int64)))[0]
    assert len(empty_matrix.tokens()) == 0 and empty_matrix.rank(3, 0) == 0


def test_another_word_tokenizer_is_left_to_the_library(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = json.load(open(path))
    other["normalizer"]["normalizers"] = other["normalizer"]["normalizers"][:2]  # keeps capitals
    (tmp_path / "t.json").write_text(json.dumps(other))
    library = Tokenizer.from_file(str(tmp_path / "t.json"))
    for text in ("Some Words HERE", "plain"):
        assert wavelet.WordEncoder(str(tmp_path / "t.json")).encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk,overlap", [(32_768, 512), (64, 16), (200, 64)])
def test_chunked_bpe(docs, rows, empty, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, x in rows:
        ids = e.encode_ordinary(x)
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    got = [tuple(r) for r in bpe_chunks.encode_decode(docs, path, chunk, overlap).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe_chunks.encode_decode(empty, path).count() == 0


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(docs, rows, empty):
    fps = [simhash(x) for _, x in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and label[j] > label[i]:
                    label[j], changed = label[i], True
    least = {}
    for (d, _), k in zip(rows, label):
        least[k] = min((x for x in (d, least.get(k)) if x is not None), default=None)
    want = [(d, f"{f:016x}", least[k]) for (d, _), f, k in zip(rows, fps, label)]
    got = [tuple(r) for r in simhash_bk.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash_bk.near_duplicates(empty).count() == 0


def test_bk_forest_connects_all_links():
    import numpy as np

    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    items = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in centre]))
    edges = simhash_bk.forest(items, items, 2)
    n = len(items)

    def roots(pairs):
        p = list(range(n))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        return [find(i) for i in range(n)]

    exact = [(i, j) for i in range(n) for j in range(i) if int(items[i] ^ items[j]).bit_count() <= 2]
    assert roots([(a % n, b % n) for a, b in edges]) == roots(exact)


def clusters(n, seed):
    """Distinct fingerprints around a few centres and anywhere."""
    import numpy as np

    rng = np.random.default_rng(seed)
    flip = lambda size: np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = rng.choice(centres, n // 2) ^ flip(n // 2) ^ flip(n // 2) ^ flip(n // 2)
    return np.unique(np.concatenate([near, rng.integers(0, 1 << 63, n - n // 2, dtype=np.uint64)]))


@pytest.mark.parametrize("tree_size", [50, 400, 100_000])
def test_shards_of_thousands_lose_no_link(spark, tree_size):
    import numpy as np

    items = clusters(4000, tree_size)
    label = np.arange(len(items))
    far = [np.flatnonzero(np.bitwise_count(items ^ x) <= 2) for x in items]
    while any((label[f] != label[f].min()).any() for f in far):
        for f in far:
            label[f] = label[f].min()
    df = spark.createDataFrame([(int(x),) for x in items.view(np.int64)], "fp long")
    got = {r.node: r.label for r in simhash_bk.components(simhash_bk.links(df, 2, tree_size)).collect()}
    named = np.array([got.get(x, x) for x in items.view(np.int64).tolist()])
    assert all(len(set(named[label == k])) == 1 for k in set(label.tolist())) and len(set(named)) == len(set(label.tolist()))


def test_trees_follow_only_edges_within_the_radius(spark):
    """The trees of sf0.1 have inner nodes, and find what a scan finds."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    items = np.array([r.fp for r in simhash_bk.fingerprints(docs).select("fp").distinct().collect()]).view(np.uint64)
    tree = simhash_bk.BKTree(items)
    inner = int((tree.children[:, 66] > tree.children[:, 0]).sum())
    assert sorted(tree.place.tolist()) == list(range(len(items))) and inner > len(items) // 5 and tree.levels > 4
    queries = items[::50]
    found = {(int(a), int(b)) for who, place in tree.near(queries, 2) for a, b in zip(who, place)}
    assert found == {(k, int(j)) for k, q in enumerate(queries) for j in np.flatnonzero(np.bitwise_count(items ^ q) <= 2)}
    for node in np.flatnonzero(tree.children[:, 66] > tree.children[:, 0])[:200]:
        for d in range(66):
            below = tree.children[node, d + 1] - tree.children[node, d]
            assert below in (0, 1)
            if below:
                assert int(tree.values[node] ^ tree.values[tree.children[node, d]]).bit_count() == d


def test_long_texts_are_hashed_in_pieces():
    text = " ".join(f"Word{k % 77} \t\n é{k % 13}" for k in range(3000))
    assert all(simhash_bk.fingerprint(text, 3, size) == simhash(text) for size in (1, 10, 1000, 1 << 20))
    assert simhash_bk.fingerprint("a b", 3, 1) == simhash("a b") and simhash_bk.fingerprint(" \n", 3, 1) == 0


def test_prefix_hashes():
    a, b = poly_hash.Prefixes("abracadabra, abracadabra!"), poly_hash.Prefixes("xabracadabrb")
    assert poly_hash.spans_equal(a, 0, b, 1, 10) and not poly_hash.spans_equal(a, 0, b, 1, 11)
    assert poly_hash.common_extension(a, 13, b, 1) == 10 and poly_hash.common_extension(a, 0, a, 13) == 11
    assert not poly_hash.spans_equal(a, 20, b, 0, 12)


def plain_spans(text, choice):
    """A text's spans between the places that its content chooses, with no prefix sums and no joined hashes."""
    base, m = poly_hash.BASES[0], poly_hash.MODULI[0]
    out, last = [], 0
    for p in range(9, len(text)):
        h = sum((ord(c) + 1) * pow(base, i, m) for i, c in enumerate(text[p - 8 : p])) % m
        mixed = (h * 0x9E3779B97F4A7C15 % 2**64) >> 40
        if mixed % (1 << choice) == 0:
            out.append(text[last:p])
            last = p
    return Counter([*out, text[last:]])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    step, choice = (max(f(len(a)), f(len(b))) for f in (poly_hash.step_of, poly_hash.choice_of))
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) // step * step
    ends = min(common(a, b) + common(a[::-1], b[::-1]), len(a), len(b))
    spans = sum(len(s) * k for s, k in (plain_spans(a, choice) & plain_spans(b, choice)).items())
    return min(1.0, max(ends, spans) / max(len(a), len(b)))


def test_likeness_against_plain_spans(docs, rows, empty):
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in poly_hash.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))[:150]
    for (d, x), (_, after) in itertools.pairwise(order):
        other = x[: len(x) - len(x) // 4] + after[: len(x) // 4]
        r = got[d, len(x), hashlib.sha256(other.encode()).hexdigest()]
        assert r.near_edited == pytest.approx(plain_likeness(x, other)) and r.near_next == pytest.approx(plain_likeness(x, after))
    for x in ODD:
        for y in ("ab " * 3000 + "tail", "one two three four five six eight", "x" * 2999):
            assert poly_hash.likeness(poly_hash.fingerprint(x or ""), poly_hash.fingerprint(y)) == pytest.approx(plain_likeness(x or "", y))


def test_likeness_sees_edits_at_both_ends_and_scattered_ones(rows):
    long = [x for _, x in rows if 1500 < len(x) < 8000][:40]
    near = lambda x, y: poly_hash.likeness(poly_hash.fingerprint(x), poly_hash.fingerprint(y))
    for x in long:
        assert near(x, "HEADER " + x + " FOOTER") > 0.7 and near(x[len(x) // 2 :] + x[: len(x) // 2], x) > 0.5
    scattered = [near(x, x[:200] + "#" + x[201 : len(x) // 2] + "#" + x[len(x) // 2 + 1 : -300] + "#" + x[-299:]) for x in long]
    assert sum(scattered) > 0.8 * len(long) and min(scattered) > 0.4
    assert sum(near(x, y) < 0.2 for x, y in itertools.pairwise(long)) > 0.9 * (len(long) - 1)


def test_blocks_give_the_same_fingerprint(monkeypatch, rows):
    texts = [x for _, x in rows if len(x) > 100][:30] + ["ab " * 4000]
    want = [poly_hash.fingerprint(x) for x in texts]
    monkeypatch.setattr(poly_hash, "BLOCK", 97)
    assert [poly_hash.fingerprint(x) for x in texts] == want
    assert poly_hash.likeness(want[-1], poly_hash.fingerprint("ab " * 3999)) > 0.99


def test_fingerprints(docs, rows, empty):
    got = poly_hash.fingerprints(docs, spread=50).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))
    assert len(got) == len(order)
    want = []
    for i, (d, x) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        want.append((d, len(x), hashlib.sha256((x[: len(x) - len(x) // 4] + after[: len(x) // 4]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > 0.6 for r in long) > 0.95 * len(long)
    assert sum(r.near_next < 0.3 for r in long) > 0.9 * len(long)
    by_text = {}
    for (d, x), r in zip(order, sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id, 0))):
        by_text.setdefault(x, set()).add(r.fingerprint) if d is not None and d >= 4 else None
    assert all(len(v) == 1 for v in by_text.values())
    assert poly_hash.fingerprints(empty).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, empty):
    got = adaptive_quality.judge(docs, columns=["doc_id"]).collect()
    want = [(d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, x in rows for c in [counts(x)]]
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept for r in got if r.base_failed)
    assert adaptive_quality.judge(empty).count() == 0
