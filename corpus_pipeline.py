"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, BPE round trip.

STAGES lists the stages; each reads what its predecessor kept, as Parquet, and all but the last return the
columns of ``documents``. run() applies them. ORACLE_SQL is None: expectation-maximisation, the components
of links and BPE merges are beyond SQL, so tests hold run() against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditweave.llm import byte_bpe, line_dedup, mixing, quality_rules, simhash
from auditweave.llm.common import staged, table
from auditweave.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or place has."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row a document."""
    return byte_bpe.digests(byte_bpe.round_trip(docs, vocabulary_path()))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mixture),
    ("bpe_round_trip", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
