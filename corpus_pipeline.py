"""The corpus pipeline: each stage applies one operator to all that the stage before kept.

All stages but the last return the columns of ``documents``, the last the digests of the encoded texts. Repeated rows
and null ids pass through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import adaptive_quality, bpe_chunks, crf_lang, near_copies, poisson_mix
from quire.llm.queries import vocabulary
from quire.llm.storage import documents, materialize

#: A document stays if its language has at least this share of its words' marginals.
LEAST_SCORE = 0.4

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds."""
    return adaptive_quality.judge(docs).where("kept").select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a determined language; the model is trained on this stage's input."""
    return crf_lang.keep_certain(docs.select(COLUMNS), crf_lang.train(docs), LEAST_SCORE)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash of five-word shingles and BK-trees find candidates, a Jaccard
    similarity of 0.8 or more decides."""
    return near_copies.deduplicate(docs.select(COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out by their Poisson counts, in global disorder."""
    return poisson_mix.mix(docs.select(COLUMNS)).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, for each document of the mixture."""
    return bpe_chunks.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("source_mixing", source_mixing), ("byte_bpe", byte_bpe)]

#: A conditional random field and SimHash can't be written in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
