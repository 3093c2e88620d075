"""Writing results: tables by dataset, N-Triples with rolling gzip files, CSV, JSON, and the run log."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import escape_literal

RUNS = "action_id string, dataset string, status string, at timestamp, params string, error string"


def statement(s: Column, p: Column, o: Column, o_kind: Column, datatype: Column | None = None, lang: Column | None = None, g: Column | None = None) -> Column:
    """A line of N-Triples (with ``g`` of N-Quads)."""
    iri = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    literal = escape_literal(o)
    if lang is not None:
        literal = F.concat(literal, F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).otherwise(F.lit("")))
    if datatype is not None:
        plain = datatype.isNull() | datatype.endswith("#string") | datatype.endswith("#langString")
        literal = F.concat(literal, F.when(plain, F.lit("")).otherwise(F.concat(F.lit("^^<"), datatype, F.lit(">"))))
    parts = [iri(s), iri(p), F.when(o_kind == "literal", literal).otherwise(iri(o))]
    if g is not None:
        parts.append(iri(g))
    return F.concat(F.concat_ws(" ", *parts), F.lit(" ."))


def write_triples(lines: DataFrame, path: str, compress: bool = True, rows_per_file: int = 0, append: bool = False) -> None:
    """Lines (one string column) as text; files roll after ``rows_per_file`` rows."""
    out = lines.write.mode("append" if append else "overwrite")
    if compress:
        out = out.option("compression", "gzip")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    out.text(path)


def write_tables(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet; only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, *partitions: str) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(*partitions) if partitions else out).json(path)


@contextmanager
def recorded_run(spark: SparkSession, path: str, dataset: str | list[str], params: str = "{}"):
    """A row for each dataset when a run starts, one when it has completed or failed; the error is raised again."""
    action, datasets = str(uuid.uuid4()), [dataset] if isinstance(dataset, str) else dataset

    def note(status: str, error: str | None = None) -> None:
        row = spark.createDataFrame([(action, d, status, params, error) for d in datasets], "action_id string, dataset string, status string, params string, error string").coalesce(1)
        row.select("action_id", "dataset", "status", F.current_timestamp().alias("at"), "params", "error").write.mode("append").parquet(path)

    note("Active")
    try:
        yield action
    except Exception as e:
        note("Failed", str(e)[:2000])
        raise
    note("Completed")


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each run and dataset."""
    latest = F.max_by(F.struct("status", "at", "params", "error"), F.struct("at", (F.col("status") != "Active").alias("s")))
    return spark.read.parquet(path).groupBy("action_id", "dataset").agg(latest.alias("r")).select("action_id", "dataset", "r.*")
