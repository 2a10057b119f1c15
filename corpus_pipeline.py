"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, secrets, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Texts go to Python in batches of
``BATCH_ROWS``, since two tasks of an executor hold a batch each on both sides. All but the last return the columns
of ``documents``; the last adds ``ids`` (SentencePiece pieces) and ``lossless`` (whether they decode to the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import checkpointed, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_crf import keep_good
from tessera.llm.merge_dropout import round_trip
from tessera.llm.near_copies import drop_near_duplicates
from tessera.llm.secrets_scan import redact_secrets

#: Rows of an Arrow batch; Spark's own 10,000 are for narrow rows.
BATCH_ROWS = 1000


def _narrow(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    _narrow(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8) stays."""
    _narrow(spark)
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    _narrow(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text."""
    _narrow(spark)
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded with merge-dropout and decoded again."""
    _narrow(spark)
    return round_trip(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", benchmark), ("secrets", secrets), ("sentencepiece", encode)]

#: Training a classifier and seeded merges are not SQL: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
