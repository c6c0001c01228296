"""A corpus pipeline of five operators: each stage works on all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerproof.llm import copies, decontaminate, langid, sentencepieces, toxicity
from ledgerproof.llm.common import materialize, table
from ledgerproof.llm.queries import PIECES


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: no letters, or a confidence below the calibrated limit."""
    return langid.kept(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the machine, trained on the labels of the documents at hand, holds toxic."""
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the least doc_id: linked by SimHash as op4 does (2 bits or fewer), or by a 5-word Jaccard of 0.8 or more, chained."""
    return copies.kept(docs, radius=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left, and decode it again."""
    return sentencepieces.encode_documents(docs, PIECES)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("encode", encode),
]

#: SQL has neither the models nor the encoder; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
