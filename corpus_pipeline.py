"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes every stage's result below the shared work folder
and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import byte_bpe, line_dedup, quality_cascade, simhash_similar, string_tiling
from tidewatch.llm.common import table
from tidewatch.session import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cascade.keep_good(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(docs, min_docs=10, min_chars=1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links of op5 (fingerprints by anchors, two bits), then those of similar shingle sets; one document of each component."""
    return simhash_similar.keep_one_similar(docs, least=0.8, size=5, threshold=2)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return string_tiling.keep_clean(docs, table(spark, sf_dir, "benchmark"), min_match=4, threshold=0.5)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", good_quality),
    ("line_dedup", without_shared_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("byte_bpe", tokens),
]

#: Fingerprints, tiles and tokens have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
