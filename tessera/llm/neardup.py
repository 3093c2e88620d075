"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles. Its sketch has ``COORDINATES`` values: in
round ``i`` every element is hashed to a bin and a value, each bin keeps the least (round, value),
and rounds go on until no bin is empty; from round ``COORDINATES`` on round ``i`` throws all elements
into one bin, so every coordinate fills however small the set is, with MinHash's concentration.

Bands of ``ROWS`` coordinates name buckets. Links are found in two steps, with no step that writes
out all pairs of a bucket of copies:

1. equal sets become one node; in each bucket the node that meets the most others is the pivot, every
   member is verified against it on the full sets, and connected components follow from that; large
   buckets that still hold several components get other pivots in turn;
2. only members of one bucket that then still lie in different components are compared: by their
   sketches, in large buckets (those of one main component merged where that is less work) by wider ones, a
   block of members with a block of outsiders at a time; pairs that stand no chance fall away, and the
   rest is compared by full sets.

A pair of similarity 0.75 misses every bucket with probability ``(1 - 0.75**ROWS) ** BANDS`` (2e-6).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import bound_batches, cut, fresh, packed, small_side, table

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
ROWS, BANDS = 5, 48
COORDINATES = ROWS * BANDS
#: Pairs with fewer equal sketch bytes are below 0.75: at 0.75 the count is 180 +- 6.7, this is 6 sigma less.
LEAST_EQUAL = 140
#: The same for the wider sketches of nodes in large buckets, four bits a coordinate: 784 +- 13.6 at 0.75, this is 5.5 sigma less.
WIDE, WIDE_LEAST_EQUAL = 1024, 709
#: Documents and shingles that are sketched at once.
SKETCHED_SETS, SKETCHED_ITEMS = 600, 250_000
#: Members of a bucket that are paired in SQL; larger buckets are cut into blocks of about so many.
SMALL_BUCKET, BLOCK = 16, 256
#: Rounds with other pivots for large buckets, before their members are compared in blocks, and pivots of a bucket in each.
EXTRA_STARS, PIVOTS = 1, 2
#: Verified pairs of one node that share a copy of its text.
PAIRS_PER_COPY = 512
_U = np.uint64


def sketch(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A (sets x coordinates) matrix of fast similarity sketches; rows of empty sets are all ones."""
    t, none = coordinates, _U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), none, _U)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    items = np.concatenate([sets[i] for i in live])
    owner = np.repeat(live, sizes[live])
    for i in range(2 * t):
        h = tb.mix(items, 100 + i)
        # bin from the upper half, value from the lower 48 bits under the round
        bins = ((h >> _U(40)) % _U(t)).astype(np.int64) if i < t else np.full(len(items), i - t)
        np.minimum.at(flat, owner * t + bins, (_U(i) << _U(48)) | (tb.mix(h, 7) >> _U(16)))
        if i < 2 or i % 4 == 3 or len(items) > 4 * t:
            full = (out[live] != none).all(axis=1)
            if full.any():
                left = np.zeros(len(sets), bool)
                left[live[~full]] = True
                keep = left[owner]
                items, owner, live = items[keep], owner[keep], live[~full]
                if not len(live):
                    break
    return out


def document_sets(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    lowered = tb.LOWER[data]
    begin, end, owner = tb.words(lowered, at)
    return tb.shingles(tb.word_hashes(lowered, begin, end), owner, k)


def _set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return tb.mix(np.array([s.sum(dtype=_U), np.bitwise_xor.reduce(tb.mix(s, 11)) + _U(len(s))], _U), 13).tobytes()


_SKETCHED = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
        first, held = 0, []
        for _, j, data, at in tb.chunks(texts):
            held += document_sets(data, at)
            # rounds of a sketch cost the same for few sets as for many
            if len(held) >= SKETCHED_SETS or sum(map(len, held)) >= SKETCHED_ITEMS or j == len(texts):
                yield _sketch_rows(ids.slice(first, j - first), keys.slice(first, j - first), held)
                first, held = j, []


def _sketch_rows(ids: pa.Array, text_keys: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    coords = sketch(sets)
    banded = coords.reshape(len(sets), BANDS, ROWS)
    keys = np.zeros((len(sets), BANDS), _U)
    for r in range(ROWS):
        keys = tb.mix(keys ^ banded[:, :, r], 31 + r)
    keys = tb.mix(keys ^ np.arange(BANDS, dtype=_U), 41)
    empty = [len(s) == 0 for s in sets]
    bands = pa.ListArray.from_arrays(
        pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).reshape(-1)), mask=pa.array(empty)
    )
    small = (tb.mix(coords, 17) >> _U(56)).astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            text_keys,
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([None if e else _set_key(s) for s, e in zip(sets, empty)], pa.binary()),
            bands,
            pa.array([None if e else row.tobytes() for row, e in zip(small, empty)], pa.binary()),
        ],
        names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "sketch"],
    )


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_key, bands, sketch; the last three are null for documents without words."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(_sketched, _SKETCHED)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keep = np.zeros(n, bool)
        for i, j, data, at in tb.chunks(batch.column(2)):
            left = document_sets(data, at)
            for k, right in zip(range(i, j), _sets_of(batch.column(3).slice(i, j - i))):
                a = left[k - i]
                both = len(np.intersect1d(a, right, assume_unique=True)) if len(a) and len(right) else 0
                keep[k] = both > 0 and DENOMINATOR * both >= NUMERATOR * (len(a) + len(right) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])


def _sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, at in tb.chunks(column):
        yield from document_sets(data, at)


def _texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the kept ``nodes`` with the text of the document and text that stands for each node."""
    named = nodes.join(classes.select("node", "doc_id", "text_key"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return texts.join(small_side(named, nodes.count()), ["doc_id", "text_key"]).select(*nodes.columns, "text")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct, kept (a, b) whose nodes' full sets are similar enough.

    Only texts of documents in a pair are shuffled. A node in many pairs gets one copy of its text
    for ``PAIRS_PER_COPY`` of them, so that no task holds all of a hub's pairs.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_COPY).alias("copies"))
    involved = cut(
        degree.select(F.col("a").alias("node"), "copies", F.lit(0).alias("right"))
        .unionByName(pairs.select(F.col("b").alias("node"), F.lit(1).alias("copies"), F.lit(1).alias("right")))
        .groupBy("node")
        .agg(F.max(F.when(F.col("right") == 0, F.col("copies"))).alias("copies"), F.max("right").alias("right"))
    )
    texts = _texts_of(involved, classes, docs)
    left = texts.filter("copies is not null").select(F.col("node").alias("a"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
    right = texts.filter("right = 1").select(F.col("node").alias("b"), F.col("text").alias("tb"))
    dealt = pairs.join(small_side(degree, involved.count()), "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).select("a", "b", "copy")
    both = dealt.join(right, "b").join(left, ["a", "copy"]).select("a", "b", "ta", "tb")
    return packed(cut(both.mapInArrow(_verified, "a long, b long").distinct()))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node in an edge (a, b).

    Alternates large and small stars until only stars are left: every node then points at its
    component's least. A round moves each edge once; no component is gathered anywhere.
    """
    n = edges.count()
    current = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n)
    while not _only_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = cut(small.filter("u <> v").distinct(), n)
        n = current.count()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    forked = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    return forked.isEmpty() and edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sketches those that may reach the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
        keep = pa.array((x == y).sum(axis=1) >= LEAST_EQUAL)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _widely_sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in tb.chunks(batch.column(1)):
            small = (tb.mix(sketch(document_sets(data, at), WIDE), 17) >> _U(60)).astype(np.uint8)
            halves = small[:, ::2] << 4 | small[:, 1::2]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([row.tobytes() for row in halves], pa.binary())], names=["node", "sketch"])


def _block_pairs(frame):
    """Pairs of a block of a bucket's members with a block of its nodes outside the main component, whose components
    differ and whose wide sketches are close. Two outsiders meet where the larger one is the member.
    """
    import pandas as pd

    node, comp, guest, outside = (frame[c].to_numpy() for c in ("node", "component", "guest", "outside"))
    a, b = [], []
    if (comp != comp[0]).any():
        packed_bits = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, WIDE // 2)
        wide = np.concatenate([packed_bits >> 4, packed_bits & 15], axis=1)
        own = np.flatnonzero(~guest)
        for k in np.flatnonzero(guest):
            at = own[(comp[own] != comp[k]) & (~outside[own] | (node[own] > node[k]))]
            at = at[(wide[at] == wide[k]).sum(axis=1) >= WIDE_LEAST_EQUAL] if len(at) else at
            a += [node[k]] * len(at)
            b += node[at].tolist()
    return pd.DataFrame({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})


def _merged_buckets(large: DataFrame) -> DataFrame:
    """``large`` (bucket, node, component, size) with the buckets of one main component merged to one where that gives fewer
    comparisons: nodes outside of it meet its members in many bands, and are then compared once and not in each.
    """
    of_size = large.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"))
    placed = large.join(of_size, "bucket")
    once = placed.groupBy("main", "node", "component").agg(F.count("*").alias("_rows"))
    wholes = once.groupBy("main").agg(F.count("*").alias("whole"), F.count_if(F.col("component") != F.col("main")).alias("outside"))
    apart = placed.filter("component <> main").groupBy("main").agg(F.sum("size").alias("apart"))
    merged = cut(wholes.join(apart, "main").filter("whole * outside < apart").select("main", "whole"))
    side = small_side(merged, merged.count())
    joint = once.join(side, "main").select(F.xxhash64(F.lit("merged"), "main").alias("bucket"), "node", "component", F.col("whole").alias("size"))
    return placed.join(side, "main", "left_anti").select("bucket", "node", "component", "size").unionByName(joint)


def _tiles(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """The members of large buckets for :func:`_block_pairs`: bucket, at, by, node, component, outside, guest, sketch.

    Members of a bucket's main component need no comparison among themselves: members, and as guests
    those outside the main component, are both dealt into blocks, and each two blocks are a group.
    """
    of_size = large.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), n).cast("int")
    placed = large.join(of_size, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    placed = placed.withColumn("_rows", blocks(F.col("size"))).withColumn("_columns", blocks(F.col("size") - F.col("most")))
    placed = placed.select("bucket", "node", "component", "outside", "_rows", "_columns").join(sketches.select("node", "sketch"), "node")
    kept = ("node", "component", "outside")
    members = placed.select("bucket", block("member", F.col("_rows")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)).alias("by"), *kept, F.lit(False).alias("guest"), "sketch")
    guests = placed.filter("outside").select("bucket", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("at"), block("guest", F.col("_columns")).alias("by"), *kept, F.lit(True).alias("guest"), "sketch")
    return members.unionByName(guests)


def close_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sketches leave a chance."""
    return (
        pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_close, "a long, b long")
        .distinct()
    )


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, component, size of the members of buckets that hold several components."""
    labelled = members.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    spread = labelled.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return packed(cut(labelled.join(spread.select("bucket", "size"), "bucket")))


def _stars(members: DataFrame, weight) -> DataFrame:
    """Distinct pairs (a < b) of each bucket's heaviest node and its members in other components."""
    pivots = members.groupBy("bucket").agg(F.max(F.struct(weight.alias("w"), (-F.col("node")).alias("n"), F.col("component").alias("c"))).alias("p"))
    pivots = pivots.select("bucket", (-F.col("p.n")).alias("_pivot"), F.col("p.c").alias("_of"))
    met = members.join(pivots, "bucket").filter("component <> _of")
    return met.select(F.least("node", "_pivot").alias("a"), F.greatest("node", "_pivot").alias("b")).distinct()


def _main_stars(members: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a < b) of each bucket's nodes outside its largest component and ``PIVOTS`` nodes of that component.

    A near copy that the first pivot missed is likely to link with one of several; who does not is few.
    """
    of_size = members.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("_main"))
    placed = members.join(of_size, "bucket")
    drawn = F.xxhash64(F.lit(turn), "node")
    pivots = placed.filter("component = _main").groupBy("bucket", F.pmod(drawn, F.lit(PIVOTS)).alias("_of")).agg(F.max(F.struct(drawn.alias("h"), F.col("node").alias("n"))).alias("p")).select("bucket", F.col("p.n").alias("_pivot"))
    met = placed.filter("component <> _main").select("bucket", "node").join(pivots, "bucket")
    return met.select(F.least("node", "_pivot").alias("a"), F.greatest("node", "_pivot").alias("b")).distinct()


def _unsettled_pairs(open_rows: DataFrame, sketches: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct pairs of nodes that share a bucket, lie in different components and may be similar enough."""
    small = open_rows.filter(F.col("size") <= SMALL_BUCKET)
    pairs = (
        small.select("bucket", F.col("node").alias("a"), F.col("component").alias("ca"))
        .join(small.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb")), "bucket")
        .filter("a < b and ca <> cb")
        .select("a", "b")
        .distinct()
    )
    large = packed(cut(_merged_buckets(open_rows.filter(F.col("size") > SMALL_BUCKET))))
    nodes = packed(cut(large.select("node").distinct()))
    wide = cut(_texts_of(nodes, classes, docs).select("node", "text").mapInArrow(_widely_sketched, "node long, sketch binary").dropDuplicates(["node"]))
    dense = packed(cut(_tiles(large, wide).groupBy("bucket", "at", "by").applyInPandas(_block_pairs, "a long, b long").distinct()))
    return close_pairs(pairs, sketches).unionByName(dense).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    A document without words or text is linked with nothing. Rows with equal doc_id are linked with each
    other (its links are those of all its texts). A row without a doc_id takes no part: its component_id
    is null and it is kept. An empty table gives no rows.
    """
    sketched = cut(sketch_documents(docs))
    sets = sketched.filter("set_key is not null and doc_id is not null")
    # a node is a class of equal sets, numbered at will; its least document and that one's text stand for it
    classes = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select("set_key", "one.doc_id", "one.text_key")
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = cut(sets.join(classes, ["set_key", "doc_id", "text_key"]).select("node", "bands", "sketch").dropDuplicates(["node"]))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = packed(cut(banded.join(shared, "bucket").select("bucket", "node", "size").distinct()))
    # documents with several sets link all of them
    owned = sets.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    twice = cut(owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a"))
    several = owned.join(small_side(twice, twice.count()), "doc_id").filter("node > a").select("a", F.col("node").alias("b")).distinct()
    sketches = nodes.select("node", "sketch")
    # the node that meets the most others is the likeliest to link with all of them
    meets = members.groupBy("node").agg(F.sum("size").alias("meets"))
    tried = packed(cut(close_pairs(_stars(members.join(meets, "node").withColumn("component", F.col("node")), F.col("meets")), sketches)))
    links = verify(tried, classes, docs).unionByName(several)
    labels = components(links)
    open_rows = _open_members(members, labels)
    for turn in range(EXTRA_STARS):
        # other pivots for the large buckets that still hold several components
        large = open_rows.filter(F.col("size") > SMALL_BUCKET)
        stars = packed(cut(close_pairs(_main_stars(large, turn), sketches).join(tried, ["a", "b"], "left_anti")))
        if stars.isEmpty():
            break
        found = verify(stars, classes, docs)
        tried = tried.unionByName(stars)
        if not found.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
            open_rows = _open_members(members, labels)
    last = packed(cut(_unsettled_pairs(open_rows, sketches, classes, docs).join(tried, ["a", "b"], "left_anti")))
    if not last.isEmpty():
        found = verify(last, classes, docs)
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    settled = cut(classes.join(labels, "node", "left").select("set_key", "doc_id", F.coalesce("component", "node").alias("component")))
    least = settled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    settled = settled.join(least, "component").select("set_key", "component_id")
    return (
        sketched.select("doc_id", "n_shingles", "set_key")
        .join(settled, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns as they are.

    Documents without words or without a doc_id stay; of rows that repeat a kept doc_id one stays.
    """
    found = cut(near_duplicates(docs.select("doc_id", "text")))
    gone = found.filter("not kept").select("doc_id").distinct()
    repeated = found.filter("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    key = fresh(docs, "gone_id")
    stay = docs.join(small_side(gone.withColumnRenamed("doc_id", key), gone.count()), docs["doc_id"].cast("long") == F.col(key), "left_anti")
    if repeated.isEmpty():
        return stay
    twice = fresh(docs, "repeated")
    marked = stay.join(small_side(repeated.select(F.col("doc_id").alias(key), F.lit(1).alias(twice)), repeated.count()), stay["doc_id"].cast("long") == F.col(key), "left")
    return marked.filter(F.col(twice).isNull()).select(*docs.columns).unionByName(
        marked.filter(F.col(twice).isNotNull()).dropDuplicates(["doc_id"]).select(*docs.columns)
    )


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
