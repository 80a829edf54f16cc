"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import base64
import hashlib
import sys
from pathlib import Path

import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_brute_force import counts
from test_near_copies import plain_groups
from test_operators_llm import named, poisson

from quire.llm import poisson_mix
from quire.llm.storage import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, "", None, None, 0), (10_002, "1234 56789 12345 67890 1234 5678 90123 4567 89012 3456 7890 12345", None, None, 0), (None, docs.first().text, "en", None, 1)], docs.schema)
    docs = materialize(docs.unionByName(more).unionByName(docs.limit(3)), "in")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = (before.collect(), docs.collect(), docs.columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(seen[n][2] == corpus_pipeline.COLUMNS for n in names[:-1])

    given, kept, _ = seen["quality_rules"]
    failed = {r.doc_id for r in given if (c := counts(r.text or ""))[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert not failed & {r.doc_id for r in kept} and len(kept) > 0.9 * (len(given) - sum(r.doc_id in failed for r in given))

    given, kept, _ = seen["language_id"]
    assert {r.doc_id for r in given} - {r.doc_id for r in kept} == {10_002}

    given, kept, _ = seen["simhash_dedup"]
    label = plain_groups([r.text for r in given])
    groups = {}
    for r, k in zip(given, label):
        groups.setdefault(k, []).append((r.doc_id is None, r.doc_id))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == sorted(min(g) for g in groups.values())

    given, kept, _ = seen["source_mixing"]
    rates = {r._source: (r.rate, r.parts) for r in poisson_mix.source_rates(spark.createDataFrame(given, more.schema)).collect()}
    want = []
    for r in given:
        rate, parts = rates[r.source]
        n = sum(poisson(int(hashlib.md5(f"17:{j}:{named(r.doc_id, r.text)}".encode()).hexdigest()[:13], 16) / 2**52, rate / parts) for j in range(parts))
        want += [str(r.doc_id)] * n
    assert sorted(str(r.doc_id) for r in kept) == sorted(want)

    given, kept, _ = seen["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = sorted((str(r.doc_id), len(ids := e.encode_ordinary(r.text)), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in given)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept) == plain
