"""A corpus pipeline over documents: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markloom.llm import fmindex, lines, minhash, packing, quality
from markloom.llm.common import stored
from markloom.llm.queries import table, vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored under 0.3 by a model of labels.quality go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: later copies of runs of any length, one line too, are cut out; a document that
    loses every line goes."""
    return lines.dedup_text(docs, 1)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents linked at a similarity of 0.8 the one with the smallest doc_id stays."""
    return minhash.keep_one(docs, 80)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: words in windows of 50 that an earlier document has are cut out; a document that
    loses every word goes."""
    return fmindex.dedup_text(docs, 50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every remaining document, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary(), 2048)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("substring_dedup", dedup_passages),
    ("best_fit_packing", pack),
]

#: A trained classifier and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
