"""The corpus pipeline: language ID, near-duplicate removal, PII, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads what it wrote.
All but the last return the columns of documents.  Defined cases are those of the operators that
the stages call: see quillgraph.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import langid, mixing, neardup, packing, pii
from quillgraph.llm.queries import MIXTURE, PACKING
from quillgraph.session import table, written

#: MinHash collisions, Viterbi and deobfuscation aren't expressible in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model is fitted on a bounded sample of labelled rows."""
    return langid.accepted(docs, langid.train(docs))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates, and all others."""
    return neardup.deduplicated(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal identifiers replaced by their kind."""
    return pii.redacted(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the largest mixture at the target weights."""
    return mixing.mixed(docs, MIXTURE)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document."""
    return packing.pack(docs, PACKING)


STAGES = [
    ("language_id", language_id),
    ("minhash_neardup", minhash_neardup),
    ("pii", pii_redaction),
    ("source_mixture", source_mixture),
    ("packing", length_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
