"""Exact top-k search by inner product: no-random-access aggregation over sorted lists, in blocks.

Every dimension of a block of vectors is a list sorted by component. A query reads the lists of its non-zero
components in rounds, from the end that raises its score. Each vector has a lower bound, what was read of it
and the lists' far ends for the rest, and an upper bound with the frontiers, the last values read, instead;
a vector that was not read at all has at most the sum of the frontiers. A query stops when few vectors have an
upper bound of its k-th best score or more, and these are resolved to their final scores. No list is read at
random. The queries of a block read the same lists, so a round works out the bounds of all that still read
as products with one table of what was read.

Each query first searches one block. Its k-th score there is a floor for the k-th score of all, with which
the searches of the other blocks begin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

TOP, SCALE, QUERY_EVERY = 20, 64, 20
#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Shares of the lists up to which the rounds read.
DEPTHS = (0.25, 0.375, 0.5, 0.625, 0.75, 0.875)
#: Whole numbers below these are exact as doubles and as floats.
_EXACT, _EXACT_SHORT = float(1 << 53), float(1 << 24)
_LONG = (1 << 63) - 1


class Lists:
    """The sorted lists of a block of vectors, which come ordered by id; counts the entries that queries read."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids, self.read = vectors, ids, 0
        self.values = np.sort(vectors, axis=0)

    def survivors(self, q: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> list[np.ndarray]:
        """For each query the indices of the vectors that may be among its ``k`` best with scores of its floor at least.

        The queries read on together and stop one by one; their bounds are sums over the same tables of what was read.
        """
        n, x, v = len(self.ids), self.vectors, self.values
        left: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        reading, done = np.arange(len(q)), 0
        used = (q != 0).sum(axis=1)
        up, down = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
        for end in sorted({max(1, int(n * d)) for d in DEPTHS} | {n}) if n else ():
            high, low = v[n - end], v[end - 1]  # the frontiers: last values read from above and from below
            a, b, floor = up[reading], down[reading], floors[reading]
            self.read += int(used[reading].sum()) * (end - done)
            done = end
            # where a vector that was not read at all could win, no vector falls away
            if end < n and (a @ high + b @ low >= floor).all() and np.isfinite(floor).all():
                continue
            kth = floor
            if not np.isfinite(floor).all():
                lower = a @ np.where(x >= high, x, v[0]).T + b @ np.where(x <= low, x, v[-1]).T
                lower[own[reading, None] == self.ids[None, :]] = -np.inf
                kth = np.maximum(floor, np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else -np.inf)
            upper = a @ np.maximum(x, high).T + b @ np.minimum(x, low).T
            # on a tie with the k-th score a smaller id could still win
            able = upper >= kth[:, None]
            stops = (able.sum(axis=1) <= max(2 * k, n // 32)) | (end == n)
            for i in np.flatnonzero(stops):
                found = np.flatnonzero(able[i])
                left[reading[i]] = found[self.ids[found] != own[reading[i]]]
            reading = reading[~stops]
            if not len(reading):
                break
        return left


def nra_top(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Query index, vector index and score of each query's ``k`` best vectors (all, if fewer), and the share of
    the lists' entries that was read.

    Both matrices hold whole numbers; ``own`` has the queries' ids, whose vectors don't count; ties go to the
    smaller id; vectors below a query's floor may be left out. Scores that could pass 2**53 are summed as Python
    integers for all vectors, as bounds of floats would not be exact; what a long can't hold is given as the nearest long.
    """
    n, d = vectors.shape
    top = max(float(np.abs(queries).max(initial=0)), float(np.abs(vectors).max(initial=0)))
    exact = top * top * max(d, 1) < _EXACT
    by_id = np.argsort(ids, kind="stable")
    ids_sorted = ids[by_id]
    x = vectors[by_id] if exact else np.vectorize(int, otypes=[object])(vectors[by_id]) if vectors.size else vectors.astype(object)
    q = queries if exact else np.vectorize(int, otypes=[object])(queries)
    if top * top * max(d, 1) < _EXACT_SHORT:
        x, q = x.astype(np.float32), q.astype(np.float32)
    lists = Lists(x, ids_sorted) if exact else None
    least = np.full(len(q), -np.inf) if floors is None else np.where(np.isnan(floors), -np.inf, floors)
    able = lists.survivors(q, own, k, least) if lists else [np.flatnonzero(ids_sorted != o) for o in own]
    qi, vi, sc = [], [], []
    for i, c in enumerate(able):
        s = x[c] @ q[i]
        best = np.argsort(-s, kind="stable")[:k]  # candidates ascend by id
        qi += [i] * len(best)
        vi += by_id[c[best]].tolist()
        sc += [max(-_LONG, min(_LONG, int(v))) for v in s[best]]
    share = lists.read / max(1, n * d * len(q)) if lists else 1.0
    return np.array(qi, np.int64), np.array(vi, np.int64), np.array(sc, np.int64), share


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: whole components floor(scale * x) as doubles; vectors that are null, without an id or hold a
    null or non-finite component are left out."""
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    # from 2**53 on every double is whole
    whole = lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False)))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c.cast("double") * scale)).alias("v")
    )


def _matrix(lists: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` highest integer inner products.

    Vectors of unequal length count as padded with zeros; the query's own id is no candidate for it;
    rows that repeat an id are candidates each; a repeated query is asked once; scores that a long can't
    hold stop at its ends. An empty table gives no rows. Vectors and queries are dealt into blocks; each
    pair of blocks is one group of bounded size that yields at most ``k`` rows a query.
    """
    rows = quantised(vectors, scale)
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "v"]).withColumn("ask_key", F.xxhash64("vec_id", "v"))
    n, m = rows.count(), queries.count()
    cells, asked = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    deal = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(parts)).cast("int")
    held = rows.select(F.col("vec_id").alias("id"), F.col("v").alias("x"), deal("v", cells).alias("cell"))
    posed = queries.withColumn("ask", deal("q", asked))
    # queries of one block begin in one cell
    first = lambda ask: F.pmod(ask, F.lit(cells)).cast("int")

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"ask_key": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        width = max(q["v"].map(len).max(), x["x"].map(len).max())
        own, ids = q["vec_id"].to_numpy(), x["id"].to_numpy()
        qi, vi, score, _ = nra_top(_matrix(q["v"], width), _matrix(x["x"], width), own, ids, k, q["floor"].to_numpy(np.float64))
        return pd.DataFrame({"ask_key": q["ask_key"].to_numpy()[qi], "query_id": own[qi], "vec_id": ids[vi], "score": score})

    def searched(asking: DataFrame, dealt: DataFrame) -> DataFrame:
        return (
            asking.groupBy("cell", "ask").cogroup(dealt.groupBy("cell", "ask")).applyInPandas(search, "ask_key long, query_id long, vec_id long, score long")
        )

    asks = F.sequence(F.lit(0), F.lit(asked - 1))
    start = held.select("*", F.explode(F.filter(asks, lambda a: first(a) == F.col("cell"))).alias("ask"))
    found = searched(posed.withColumn("cell", first(F.col("ask"))).withColumn("floor", F.lit(None).cast("double")), start)
    if cells > 1:
        found = cut(found)
        floors = found.groupBy("ask_key", "query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).filter(F.col("n") >= k)
        bounded = posed.join(floors.select("ask_key", F.col("query_id").alias("vec_id"), "floor"), ["ask_key", "vec_id"], "left")
        elsewhere = bounded.withColumn("cell", F.explode(F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: c != first(F.col("ask")))))
        rest = held.select("*", F.explode(F.filter(asks, lambda a: first(a) != F.col("cell"))).alias("ask"))
        found = found.unionByName(searched(elsewhere, rest))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every query vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE_TOPK = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
