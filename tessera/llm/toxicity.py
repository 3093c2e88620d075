"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words and their beginnings (``PREFIXES`` bytes), hashed to ``2**BUCKET_BITS``
buckets. The buckets that tell the labels apart best are found by a distributed count of documents,
and a factorization machine learns a weight for each and a vector for the pairs: two terms that are
harmless alone (an insult, a group) may be toxic together, which additive weights cannot say.

The counts cover all labelled rows outside the held-out fold, the scores all rows. The machine is fitted on
a sample of at most about ``MAX_TRAINING_ROWS`` of the labelled rows, and on up to ``ROWS_OF_RARE`` rows of each
kept bucket that the sample may have in fewer. Only the kept buckets of these rows (some MB) and the model
(about 1 MB, whatever the corpus) meet on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import bound_batches, mapped_rows, small_side, table

#: Bound of the rows that the machine is fitted on.
MAX_TRAINING_ROWS = 20_000
#: Rows of each kept bucket that the fit sees, where the sample may have fewer.
ROWS_OF_RARE = 16
FOLDS, HELD_OUT_FOLD = 5, 0
BUCKET_BITS, KEPT_BUCKETS, FACTORS = 18, 4096, 8
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 15, 256, 0.03, 0.02
#: Least log odds of a kept bucket, times the root of its documents (at most 400): chance gives about 2.
LEAST_ODDS = 4.5
#: Bytes between words: ASCII other than letters and digits.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    """``slot`` maps a bucket to its weight's index or -1."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def _buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every term of the texts, repeated ones too."""
    lowered = tb.LOWER[data]
    begin, end, owner = tb.words(lowered, at, _BREAK)
    text = np.repeat(np.arange(len(at) - 1), np.diff(owner))
    sums, shift = tb.prefix_sums(lowered), np.uint64(64 - BUCKET_BITS)
    buckets, texts = [tb.mix(tb.substring_hash(sums, begin, end), 51) >> shift], [text]
    for n in PREFIXES:
        long = end - begin > n
        b = begin[long]
        buckets.append(tb.mix(tb.substring_hash(sums, b, b + n), 52 + n) >> shift)
        texts.append(text[long])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(texts)


def _kept_terms(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, weight index), ordered by text."""
    buckets, texts = _buckets(data, at)
    slot = model.slot[buckets]
    known = slot >= 0
    pairs = np.unique(texts[known] * np.int64(KEPT_BUCKETS) + slot[known])
    return pairs // KEPT_BUCKETS, pairs % KEPT_BUCKETS


def _raw(bias: float, w: np.ndarray, v: np.ndarray, text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's sums for ``n`` texts and the texts' vector sums."""
    linear = np.bincount(text, w[term], n)
    own = v[term]
    total = np.stack([np.bincount(text, own[:, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(text, (own * own).sum(axis=1), n)
    return bias + linear + 0.5 * ((total * total).sum(axis=1) - squares), total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for i, j, data, at in tb.chunks(column):
        text, term = _kept_terms(model, data, at)
        out[i:j] = _sigmoid(_raw(model.bias, model.weights, model.vectors, text, term, j - i)[0])
    return out


def _fit(slot: np.ndarray, terms: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the logistic loss; the same rows in the same order give the same model."""
    n, rng = len(terms), np.random.Generator(np.random.PCG64(5))
    bias = float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 1.5)))
    params = [np.array([bias]), np.zeros(KEPT_BUCKETS), rng.normal(0, 0.02, (KEPT_BUCKETS, FACTORS))]
    if not n or labels.min() == labels.max():
        return Model(slot, bias, params[1], params[2] * 0)
    moments, steps = [[np.zeros_like(p), np.zeros_like(p)] for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            term = np.concatenate([terms[r] for r in rows]).astype(np.int64)
            text = np.repeat(np.arange(len(rows)), [len(terms[r]) for r in rows])
            raw, total = _raw(params[0][0], params[1], params[2], text, term, len(rows))
            g = (_sigmoid(raw) - labels[rows]) / len(rows)
            gt = g[text]
            pull = gt[:, None] * (total[text] - params[2][term])
            grads = [
                np.array([g.sum()]),
                np.bincount(term, gt, KEPT_BUCKETS),
                np.stack([np.bincount(term, pull[:, f], KEPT_BUCKETS) for f in range(FACTORS)], axis=1),
            ]
            steps += 1
            for p, d, m in zip(params, grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.999 * m[1] + 0.001 * d * d
                p -= RATE * ((m[0] / (1 - 0.9**steps)) / (np.sqrt(m[1] / (1 - 0.999**steps)) + 1e-8) + (DECAY * p if p is not params[0] else 0))
    return Model(slot, float(params[0][0]), params[1], params[2])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, most: int | None = MAX_TRAINING_ROWS, also: DataFrame | None = None) -> DataFrame:
    """_id, text, toxic of about ``most`` labelled rows outside the held-out fold (without it: of all), the same on
    every run, and of those whose ``_id`` is in ``also``.

    Rows without a label or text are left out; where a document has both labels, 1 holds.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = usable.count()
    if most is not None and n > most:
        sample = usable.filter(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(n)) < most)
        usable = sample if also is None else sample.unionByName(usable.join(also.select("_id").distinct(), "_id", "left_semi")).distinct()
        n = most if also is None else most + KEPT_BUCKETS * ROWS_OF_RARE
    return docs.select(F.col("doc_id").cast("long").alias("_id"), "text").filter("text is not null").join(small_side(usable, n), "_id").select("_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    bound_batches(docs.sparkSession)
    everything = training_rows(docs, labels, None)
    rows = everything.select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, at in tb.chunks(batch.column(0)):
                buckets, texts = _buckets(data, at)
                pairs = np.unique(texts * np.int64(1 << BUCKET_BITS) + buckets)
                hit = toxic[i:j][pairs >> BUCKET_BITS]
                for k in (0, 1):
                    seen[k] += np.bincount(pairs[hit == bool(k)] & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0][some]), pa.array(seen[1][some])], names=["bucket", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean_n, toxic_n = totals.get(0, 0), totals.get(1, 0)
    counted = rows.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # the log odds between the classes, weighed by the number of documents that carry the term
    odds = F.abs(F.ln((F.col("t") + 0.5) / (toxic_n + 1)) - F.ln((F.col("c") + 0.5) / (clean_n + 1))) * F.sqrt(F.least(F.col("c") + F.col("t"), F.lit(400)))
    best = counted.filter("c + t >= 3").withColumn("_odds", odds).filter(F.col("_odds") >= LEAST_ODDS).orderBy(F.desc("_odds"), "bucket").limit(KEPT_BUCKETS).collect()
    slot = np.full(1 << BUCKET_BITS, -1, np.int64)
    slot[[r["bucket"] for r in best]] = np.arange(len(best))
    model = Model(slot, 0.0, np.zeros(KEPT_BUCKETS), np.zeros((KEPT_BUCKETS, FACTORS)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tb.chunks(batch.column(1)):
                text, term = _kept_terms(shared.value, data, at)
                ends = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), lists], names=["_id", "toxic", "terms"])

    # kept buckets that the sample may have in too few rows to learn them from
    n = clean_n + toxic_n
    rare = np.array([(r["c"] + r["t"]) * most < 2 * ROWS_OF_RARE * n for r in best], bool)
    also = None
    if n > most and rare.any():

        def carriers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, at in tb.chunks(batch.column(1)):
                    text, term = _kept_terms(shared.value, data, at)
                    few = rare[term]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(text[few])), pa.array(term[few])], names=["_id", "term"])

        nearest = Window.partitionBy("term").orderBy(F.xxhash64(F.lit("rare"), "_id"), "_id")
        carried = everything.mapInArrow(carriers, "_id long, term long").withColumn("_at", F.row_number().over(nearest))
        also = carried.filter(F.col("_at") <= ROWS_OF_RARE).select("_id")
    got = training_rows(docs, labels, most, also).mapInArrow(kept, "_id long, toxic int, terms array<int>").toPandas()
    got = got.sort_values("_id", kind="stable")  # the order in which executors answer does not matter
    return _fit(slot, [np.asarray(t, np.int64) for t in got["terms"]], got["toxic"].to_numpy(np.float64))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; null and empty texts get the model's bias.

    Equal texts score alike; a row without a doc_id is not held out; an empty table gives no rows;
    without labelled rows, or with rows of one label, every score is the smoothed share of toxic ones.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, batch.column(1)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model takes for clean, with their columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return mapped_rows(docs, lambda batch: batch.filter(pa.array(scores(shared.value, batch.column(at)) < 0.5)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
