"""Helpers shared by the corpus operators: lineage cuts, size-checked broadcasts, row numbers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of two or three integers that a broadcast side may have at most (about 32 MB as a hashed relation).
BROADCAST_ROWS = 500_000
#: Rows of a few integers for each task where their number is known.
TASK_ROWS = 100_000
#: Documents that one Arrow batch holds, and that Python works on at a time where it answers with whole rows.
ARROW_ROWS, SLICE_ROWS = 1200, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(sc: SparkContext) -> str:
    """The folder for checkpoints and tables of a run, which all executors can reach.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Where that is unset a temporary one is
    made, but only for a local master: on a cluster it is an error.
    """
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"checkpoint-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint.

    Where a bound of its ``rows`` of a few integers is known, the last stage has a task for every
    ``TASK_ROWS`` of them: a few rows in hundreds of partitions cost more in files than in data.
    """
    sc = df.sparkSession.sparkContext
    shared_folder(sc)
    return (df if rows is None else df.coalesce(max(1, -(-rows // TASK_ROWS)))).checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """``df``, a cut table of a few integers a row, read by one task for every ``TASK_ROWS`` rows: what a
    shuffle writes has files for each of its tasks, however few their rows."""
    return df.coalesce(max(1, -(-df.count() // TASK_ROWS)))


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Let the session send texts to Python in small Arrow batches.

    A batch is held whole on both sides, so its rows bound the memory of a task beside its longest text;
    a session that asks for less keeps its setting.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for a broadcast if its counted ``rows`` are few, else as it is (shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    names, out = {c.lower() for c in df.columns}, stem
    while out.lower() in names:
        out += "_"
    return out


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Give every row its 0-based global rank by ``order`` as ``row_num``; also return the row count.

    A range shuffle sorts the rows, each partition numbers its own, and the partitions' offsets
    (one row per partition) are joined back, so no task sees more than its share. The result does
    not depend on where the ranges end. ``order`` must tell apart all rows that differ.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order]
    )
    at = F.monotonically_increasing_id()
    held = cut(ranged.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_part"]: r["n"] for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one per partition
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    if not offsets:
        return held.withColumn("row_num", F.col("_at")).drop("_part", "_at"), 0
    start = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("_part"))
    if len(offsets) > 64:  # a map literal is searched in order
        side = df.sparkSession.createDataFrame(offsets, "_part int, _start long")
        held = held.join(F.broadcast(side), "_part")
        start = F.col("_start")
    return held.withColumn("row_num", (start + F.col("_at")).cast("long")).drop("_part", "_at", "_start"), total


def mapped_rows(docs: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``docs`` with each slice of at most ``SLICE_ROWS`` rows passed through ``change``, which may drop rows or replace
    columns in place; columns keep their order, names (repeated ones too) and types.

    Whole rows go to Python and back as Arrow, so no copy of them waits in the JVM for an answer.
    """
    bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                yield change(batch.slice(k, SLICE_ROWS))

    return docs.toDF(*schema.names).mapInArrow(run, schema).toDF(*docs.columns)


def utf8(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def written(df: DataFrame) -> DataFrame:
    """Run ``df`` once into a Parquet table in the shared checkpoint folder and read that back.

    Smaller on disk than a checkpoint of wide rows; recovers from lost executors in the same way.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark.sparkContext)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
