"""Corpus pipeline: documents in a known language, one of each near-duplicate group, without benchmark copies, with secrets
masked, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daymosaic.llm import decontamination, language_id, packing, secrets, similar, simhash
from daymosaic.llm.base import materialise, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_only(docs, table(spark, sf_dir, "pages"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of shingle samples meet on vantage-point trees; exact Jaccard similarity of five-word shingles, at 0.8, decides."""
    return simhash.one_of_each(docs, similar.near_copies(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs)


STAGES = [("language_id", known_languages), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("secret_scan", mask_secrets), ("packing", pack)]

#: Tokens, alignments and fingerprint components are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is stored and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
