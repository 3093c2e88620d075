"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row ``r`` of ``n`` goes to position ``p = permute(r, n, key)``, shard ``p % shards`` and slot
``p // shards``. The permutation is a keyed bijection on ``[0, n)``, so the shuffle is reproducible,
shard sizes differ by one row at most (law ``rows``), slots have no gaps, and both directions are
computed from one number: no table of the order is kept or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import number_rows, table, utf8

ROUNDS = 6
KEY = 20_240_917


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser; multiplication wraps."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, key: int, inverse: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        k = key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03
        if inverse:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Positions of ``rows`` (each in ``[0, n)``), or with ``inverse`` the rows at these positions.

    The network permutes ``[0, 4**half)``, less than ``4 * n`` (for ``n > 1``); a value that falls
    outside ``[0, n)`` walks along its cycle until one is inside, which keeps the map a bijection.
    """
    half = _half_bits(n)
    out = _network(np.asarray(rows).astype(np.uint64), half, key, inverse)
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = _network(out[outside], half, key, inverse)
    return out.astype(np.int64)


def place(row: int, n: int, shards: int, key: int = KEY) -> tuple[int, int]:
    """Shard and slot of one row number, without any data."""
    p = int(permute(np.array([row]), n, key)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int = KEY) -> int:
    """The row number that lies in this slot."""
    return int(permute(np.array([slot * shards + shard]), n, key, inverse=True)[0])


def shard_rows(df: DataFrame, order: list[str], shards: int, key: int = KEY) -> DataFrame:
    """``df`` with ``row_num``, ``shard`` and ``slot``; rows are numbered by ``order``.

    An empty table gives an empty result. Rows that are equal in all of ``order`` are
    interchangeable. Every row gets its own slot, repeated rows and nulls (first) too.
    """
    numbered, n = number_rows(df, *order)

    def positions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, key), dtype="int64")

    position = F.pandas_udf(positions, "long")
    return (
        numbered.withColumn("_position", position("row_num"))
        .withColumn("shard", (F.col("_position") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_position div {int(shards)}"))
        .drop("_position")
    )


def shard_documents(docs: DataFrame, shards: int = 8, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row_num, shard, slot of each document; null texts count as empty.

    Rows are numbered by doc_id (null first), then by the text's CRC and size.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(utf8()) + 1).cast("long").alias("size"),
        F.crc32(utf8().cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows, ["doc_id", "text_crc32", "size"], shards, key)


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``rows``."""
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_num"
    )
