"""The corpus pipeline: documents in, cleaned and encoded documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet to the shared folder and reads again as the next stage's docs, so a lost executor
costs no more than a part of one stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import bpe, decontaminate, neardup, passages, quality
from vecspark.llm.common import Scratch, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return neardup.keep_one(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay only in the first document that holds them."""
    return passages.cut_repeats(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item's window occurs go."""
    return decontaminate.drop_contaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each whole text, their number, and the digest of what they decode to."""
    return bpe.encode(docs, bpe.default_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_neardup", minhash_neardup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Trained trees, minwise joins and BPE are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
