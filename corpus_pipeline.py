"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

toxicity: documents that the factorization machine takes for toxic go.
near-dedup: one document of each near-duplicate group stays, the one with the least doc_id.
personal data: spans are replaced by their kind in brackets, and n_chars is counted anew.
mixing: documents are taken as often as their source's budget says; a row for each time.
tokens: SentencePiece ids, with the text they decode to.

All stages but the last return the columns of their input. Counts, sketches, targets and thresholds
come from all rows that the stage before has kept; the toxicity model alone is fitted on a bounded
sample of labelled rows. Null texts and empty tables pass through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table
from tessera.llm.mixing import mixed_documents
from tessera.llm.neardup import deduplicate
from tessera.llm.pii import redact_personal_data
from tessera.llm.sentencepieces import encode_documents, model_bytes
from tessera.llm.toxicity import reject_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from the labelled rows of this stage's documents."""
    return reject_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without personal data."""
    return redact_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, decoded, parity, n_tokens of each row."""
    return encode_documents(docs, model_bytes()).withColumn("n_tokens", F.size("tokens").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Trained and sketched stages can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is a table in the shared folder of ``spark.checkpoint.dir``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark.sparkContext)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
