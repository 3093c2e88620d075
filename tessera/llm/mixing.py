"""Mixing sources to target weights by hash-threshold histograms.

Each row has a reproducible 64-bit hash. Token counts are summed by source and hash bucket;
the running sum over the buckets says in which bucket a source's budget ends, and only that bucket
is summed again by finer buckets. What lies below the threshold is taken: nested budgets take nested
sets, and no document is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, fresh, small_side, table, utf8, written

#: Most times that a source may be repeated.
MOST_REPEATS = 3
#: Bits of the hash that each histogram resolves, and the number of histograms.
BITS, LEVELS = 10, 3
#: Equal rows that one task numbers.
COPIES = 1 << 16
WORD = "[^\\x20\\x09-\\x0D]+"
SALT = "mix-1"


def word_count(text: str = "text") -> Column:
    """Number of maximal runs of characters other than ASCII white space; null has none."""
    return F.regexp_count(utf8(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; the targets share the sum of all
    sizes by weight, none above ``MOST_REPEATS`` times its source, what is cut off being shared
    among the others by weight until none is above. That end state is: with the sources in order of
    cap by weight, a first part of them at their caps, the rest in proportion to weight. One row per
    source is ordered here, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last()))).withColumn(
        "weight", (F.col("_rank") - 1) % 3 + 1
    )
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "_rank")
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - MOST_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = weighed.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= MOST_REPEATS * F.col("source_size"))
    # the first source that stays below its cap sets the level for all after it
    shared = F.min(F.when(F.col("_free"), F.struct(F.col("source_size") / F.col("weight"), F.col("_rank"), F.col("_level")))).over(everything)
    return leveled.withColumn("_shared", shared["_level"]).select(
        "source",
        "source_size",
        F.least(F.col("_shared") * F.col("weight"), (MOST_REPEATS * F.col("source_size")).cast("double"))
        .cast("double")
        .alias("target"),
    )


def thresholds(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, times, below: how often a whole source is taken, and the hash prefix
    (of ``LEVELS * BITS`` bits) below which a document is taken once more.

    ``hashed`` has source, size, prefix. Each level sums at most ``2**BITS`` buckets a source.
    """
    state = targets.withColumn("times", F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(MOST_REPEATS))).select(
        "source",
        "source_size",
        "target",
        "times",
        (F.col("target") - F.col("times") * F.col("source_size")).alias("_left"),
        F.lit(0).cast("long").alias("below"),
    )
    rows = hashed.filter("size > 0")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        side = cut(state)
        joined = rows.join(small_side(side.select(F.col("source").alias("_s"), F.col("below").alias("_below")), side.count()), F.col("source").eqNullSafe(F.col("_s")))
        # the boundary bucket of the level above: all rows at first
        inside = joined.filter(F.shiftrightunsigned("prefix", shift + BITS) == F.shiftrightunsigned("_below", shift + BITS)) if level else joined
        sums = inside.groupBy("source", F.shiftrightunsigned("prefix", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        running = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket"))
        sums = sums.withColumn("_running", running)
        fits = sums.join(side.select(F.col("source").alias("_s"), "_left"), F.col("source").eqNullSafe(F.col("_s")))
        # the first bucket that does not fit whole, and what is left of the budget when it begins
        edge = (
            fits.filter(F.col("_running") > F.col("_left"))
            .groupBy("source")
            .agg(F.min(F.struct("_bucket", (F.col("_running") - F.col("_sum")).alias("_used"), "_sum")).alias("_edge"))
            .select(F.col("source").alias("_s"), "_edge")
        )
        # in the finest histogram the boundary bucket is taken if that comes nearer to the budget
        over = (F.col("_left") - F.col("_edge._used") > F.col("_edge._sum") / 2).cast("long") if level == LEVELS - 1 else F.lit(0)
        state = side.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source",
            "source_size",
            "target",
            "times",
            (F.col("_left") - F.coalesce(F.col("_edge._used"), F.lit(0))).alias("_left"),
            # no such bucket: all that is left fits (only where rounding leaves nothing over)
            F.coalesce(F.shiftleft("_edge._bucket", shift) + over, F.col("below")).alias("below"),
        )
    return cut(state.drop("_left"))


def hash_prefix(*of: Column) -> Column:
    """The upper bits of a reproducible hash of a row and its number among rows like it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SALT), *of), 64 - BITS * LEVELS)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""
    maps = {f.name for f in docs.schema.fields if isinstance(f.dataType, T.MapType)}
    return F.xxhash64(*[F.to_json(c) if c in maps else F.col(c) for c in docs.columns])


def _with_copies(groups: DataFrame, *keys: str) -> DataFrame:
    """A row with ``copy`` (from 0) for each of the ``n`` rows of each group; a group of more than ``COPIES`` rows is
    dealt to many tasks."""
    many = groups.filter(F.col("n") > COPIES).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    many = many.repartition(*[F.col(k) for k in keys], F.col("_chunk"))
    last = F.least(F.col("n"), (F.col("_chunk") + 1) * COPIES) - 1
    many = many.withColumn("copy", F.explode(F.sequence(F.col("_chunk") * COPIES, last))).drop("_chunk")
    return groups.filter(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).unionByName(many)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document.

    Null texts and texts without words have size 0 and are taken 0 words; a null source is a source
    of its own; an empty table gives no rows. A row's fate hangs on all its columns, so rows that share
    an id (or have none) part; rows equal in all columns are numbered and part by their number.
    """
    keys = ("doc_id", "source", "size", "hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), row_key(docs).alias("hash"))
    groups = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")))
    hashed = _with_copies(groups, *keys).withColumn("prefix", hash_prefix(F.col("hash"), F.col("copy")))
    bounds = thresholds(hashed, source_targets(hashed))
    return with_takes(hashed, bounds).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_takes")).alias("taken"), F.col("_takes").alias("times"))


def with_takes(hashed: DataFrame, bounds: DataFrame) -> DataFrame:
    side = small_side(bounds.withColumnRenamed("source", "_s"), bounds.count())
    return hashed.join(side, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_takes", F.least(F.col("times") + (F.col("prefix") < F.col("below")).cast("long"), F.lit(MOST_REPEATS))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their columns as they are.

    A row is known by the hash of all its columns; rows equal in all of them are numbered.
    """
    key, times, src = fresh(docs, "row_key"), fresh(docs, "takes"), fresh(docs, "mix_source")
    groups = cut(docs.select("source", word_count().alias("size"), row_key(docs).alias("hash")).groupBy("source", "size", "hash").agg(F.count("*").alias("n")))
    hashed = _with_copies(groups, "hash").withColumn("prefix", hash_prefix(F.col("hash"), F.col("copy")))
    bounds = thresholds(hashed, source_targets(hashed))
    side = small_side(bounds.select(F.col("source").alias(src), F.struct("times", "below").alias(times)), bounds.count())

    def taken(rows: DataFrame, prefix: Column) -> DataFrame:
        met = rows.join(side, F.col("source").eqNullSafe(F.col(src)))
        found = F.least(F.col(f"{times}.times") + (prefix < F.col(f"{times}.below")).cast("long"), F.lit(MOST_REPEATS)).cast("int")
        met = met.withColumn(times, found).filter(F.col(times) > 0)
        return met.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)

    keyed = docs.withColumn(key, row_key(docs))
    repeated = groups.filter("n > 1").select(F.col("hash").alias(src), F.col("n").alias(times))
    count = repeated.count()
    if not count:
        return taken(keyed, hash_prefix(F.col(key), F.lit(0).cast("long")))
    rows_of = small_side(repeated, count)
    single = keyed.join(rows_of, F.col(key) == F.col(src), "left_anti")
    # equal rows: one of them, as often as there are
    one = keyed.join(rows_of, F.col(key) == F.col(src)).groupBy(key).agg(F.first(F.struct(*docs.columns)).alias("_row"), F.max(times).alias("n"))
    one = written(one.select(F.col(key).alias("_key"), "n", *[F.col("_row")[c].alias(f"_c{k}") for k, c in enumerate(docs.columns)]))
    copies = _with_copies(one, "_key").select("_key", F.col("copy").alias("_copy"), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return taken(single, hash_prefix(F.col(key), F.lit(0).cast("long"))).unionByName(taken(copies, hash_prefix(F.col("_key"), F.col("_copy"))))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"))
