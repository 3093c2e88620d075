"""The log as a stream: template usage by day, and executions met with their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import identity_parameters, template_text
from tessera.operators.tokenizer import TokenOptions, decompose


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def template_usage_by_window(log: DataFrame, window: str = "1 day", late: str = "1 hour", options: TokenOptions = TokenOptions()) -> DataFrame:
    """window_start, template, num_exec of executions (ts timestamp, text); state older than ``late`` is dropped."""
    d = decompose(F.col("text"), options)
    named = log.withColumn("_d", d).withColumn("template", template_text(F.col("_d.pieces"), identity_parameters(F.col("_d.constants"))))
    counted = named.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "template").agg(F.count("*").alias("num_exec"))
    return counted.select(F.col("w.start").alias("window_start"), "template", "num_exec")


def executions_with_text(execs: DataFrame, queries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream join of executions (id, ts) with query texts (id, text, seen), each waiting for the other."""
    left = execs.withWatermark("ts", late).alias("e")
    right = queries.withWatermark("seen", late).alias("q")
    near = F.expr(f"e.id = q.id AND e.ts BETWEEN q.seen - INTERVAL {late} AND q.seen + INTERVAL {late}")
    return left.join(right, near).select(F.col("e.id").alias("id"), F.col("e.ts").alias("ts"), F.col("q.text").alias("text"))
