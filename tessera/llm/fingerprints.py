"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

A text is brought to one form (Unicode NFKC, case folding, white space folded to single spaces) and
hashed by two xxhash64 of different seeds, 128 bits. Texts that share a hash are then compared by
their bytes: grouping by hash *and* canonical text shows any bucket with two different texts, whose
members get an ordinal, so that equal fingerprints mean equal canonical texts. An exact digest has
no notion of nearness: likeness is 1.0 for equal fingerprints (and equal bytes), else 0.0.

A text and its successor by doc_id meet by ranges of doc_id: quantiles cut the ids into buckets,
the first row of a bucket is also handed to the bucket before it, and ``lead`` runs inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, cut, table, utf8

SALT = "fingerprint-2"
#: Quantiles of doc_id: at least so many, and one for so many rows at most.
LEAST_RANGES, ROWS_IN_RANGE, MOST_RANGES = 512, 20_000, 65_536


def canonical(text: Column) -> Column:
    """NFKC, full case folding, runs of white space as one space, none at the ends; null as empty.

    Spark has no function of its own for normalisation; ``java_method`` calls the ICU library that
    comes with Spark inside the JVM.
    """
    icu = lambda cls, name, x: F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(name), x, F.lit(True))
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """32 hex digits."""
    return F.lower(
        F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SALT), canon)), 16, "0"))
    )


def colliding_texts(docs: DataFrame, hashed=wide_hash) -> DataFrame:
    """The hashes that two different canonical texts share (normally none).

    Copies collapse before the shuffle; a bucket holds different texts of one hash only.
    """
    texts = docs.select(canonical(utf8()).alias("canon")).select(hashed(F.col("canon")).alias("hash"), "canon")
    distinct = texts.groupBy("hash", "canon").agg(F.lit(1).alias("one"))
    shared = distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    return shared


def _range_bounds(docs: DataFrame) -> tuple[list[int], int]:
    """Ascending ids that begin a range each, and the number of rows; the lists are bounded by MOST_RANGES."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    n = ids.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // ROWS_IN_RANGE))
    got = ids.agg(F.min("id").alias("least"), F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")).first()
    return sorted({x for x in [got["least"], *(got["cuts"] or [])] if x is not None}), n


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Index of the range that holds the id, by two short searches; null ids lie in range 0."""
    step = max(1, round(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads, fine = F.array(*[F.lit(c[0]) for c in chunks]), F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks])
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= doc_id))
    chunk = F.greatest(upto(heads), F.lit(1))
    return F.coalesce((chunk - 1) * step + F.greatest(upto(F.element_at(fine, chunk)), F.lit(1)) - 1, F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the following row by doc_id (null first; equal ids by text),
    after the last row that of the first. Null texts are empty."""
    bounds, _ = _range_bounds(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    if not bounds:
        bounds = [0]
    has_null = not rows.filter("doc_id is null").isEmpty()
    n = len(bounds)
    own = _range_of(F.col("doc_id"), bounds)
    # rows that begin a range go to the range before it as well, those that begin the table to the last
    begins = F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("doc_id")) if n <= 64 else F.col("_own") > _range_of(F.col("doc_id") - 1, bounds)
    first = F.col("doc_id").isNull() if has_null else F.col("doc_id") == bounds[0]
    before = F.when(first, n - 1).when(F.col("_own") > 0, F.when(begins, F.col("_own") - 1))
    dealt = rows.withColumn("_own", own).withColumn("_before", before)
    dealt = dealt.select(
        "doc_id",
        "text",
        F.explode(
            F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_own").alias("range"), F.lit(0).alias("ghost")))).otherwise(
                F.array(F.struct(F.col("_own").alias("range"), F.lit(0).alias("ghost")), F.struct(F.col("_before").alias("range"), F.lit(1).alias("ghost")))
            )
        ).alias("_in"),
    ).select("doc_id", "text", "_in.*")
    w = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).filter("ghost = 0").drop("ghost", "range")


def fingerprint_documents(docs: DataFrame, edited: bool = True) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next document's. Null texts are empty, empty texts share a fingerprint; repeated
    rows get one row each; an empty table gives none.
    """
    shared = cut(colliding_texts(docs))
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("_c"),
        canonical(F.col("edited")).alias("_e"),
        canonical(F.col("next_text")).alias("_n"),
    )
    rows = rows.withColumn("fingerprint", wide_hash(F.col("_c"))).withColumn("edited_fingerprint", wide_hash(F.col("_e")))
    if not shared.isEmpty():
        rows = _tell_apart(rows, docs, shared)
    likeness = lambda a, b: (a == b).cast("double")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("_c"), F.col("_e")).alias("near_edited"),
        likeness(F.col("_c"), F.col("_n")).alias("near_next"),
    )


def _tell_apart(rows: DataFrame, docs: DataFrame, shared: DataFrame, hashed=wide_hash) -> DataFrame:
    """Append to colliding fingerprints the canonical text's SHA-256, so that different bytes differ."""
    side = shared.select("hash")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    for name, canon in (("fingerprint", "_c"), ("edited_fingerprint", "_e")):
        s = side.withColumnRenamed("hash", f"_{name}")
        rows = rows.join(s, rows[name] == s[f"_{name}"], "left").withColumn(
            name, F.when(F.col(f"_{name}").isNotNull(), F.concat(F.col(name), F.lit("-"), F.sha2(F.col(canon).cast("binary"), 256))).otherwise(F.col(name))
        ).drop(f"_{name}")
    return rows


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
