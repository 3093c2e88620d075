"""Conversation prefix trie by heavy-path decomposition.

A node is a distinct sequence of first turns. A prefix of a conversation is known by two 64-bit exclusive-or
sums of the hashes of (place, turn), so all prefixes come from one running sum along each conversation, and the
nodes from one grouping. A node's largest child continues its path; the others are light: they begin a path
of their own. A light child holds at most half of its parent's conversations, so no way down has more light
nodes than the logarithm of the number of conversations.

Along a conversation the smallest member of its prefixes never decreases; thus a node is (smallest member,
depth), and the head of its path is the last light node above it. Totals of subtrees are suffix sums along the
paths: paths with the most light nodes above them first, each path's total being added to the parent of its
head before the round of the paths above. A node takes part in one round.

Order along a conversation or a path is worked out by stretches of ``STRETCH`` places whose totals are
joined as offsets, so one very long conversation is not one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, number_rows, small_side, table, utf8, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Conversations that share a first one, and a bound of the turns that they take from it.
BLOCK, BORROWED = 20, 4
#: Places of a conversation or path that one window orders; ids that are joined to one string.
STRETCH, CHUNK = 4096, 4096
#: Nodes with more conversations meet these as a broadcast side, which so has at most ``HOT_NODES`` rows.
HOT, HOT_NODES = 10_000, 200_000

_COMBINED = {
    "sum": (F.sum, lambda own, before: own + F.coalesce(before, F.lit(0))),
    "xor": (F.bit_xor, lambda own, before: own.bitwiseXOR(F.coalesce(before, F.lit(0)))),
    "max": (F.max, lambda own, before: F.greatest(own, before)),
}


def running(rows: DataFrame, keys: tuple[str, ...], order: str, most: int, **sums: tuple[str, Column, int]) -> DataFrame:
    """``rows`` with a running aggregate for each of ``sums`` (kind, value, 0 with or -1 without the row itself) along
    ``order``, whole numbers from 0 to ``most`` that are distinct for each of the ``keys``."""
    stretched = rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH)).withColumns({f"_of_{n}": value for n, (_, value, _) in sums.items()})
    frame = lambda by, along, last: Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, last)
    parts = (*keys, "_stretch")
    if most < STRETCH:
        out = stretched.withColumns({n: _COMBINED[kind][0](f"_of_{n}").over(frame(parts, order, last)) for n, (kind, _, last) in sums.items()})
        return out.drop("_stretch", *[f"_of_{n}" for n in sums])
    totals = stretched.groupBy(*parts).agg(*[_COMBINED[kind][0](f"_of_{n}").alias(f"_of_{n}") for n, (kind, _, _) in sums.items()])
    before = totals.select(*parts, *[_COMBINED[kind][0](f"_of_{n}").over(frame(keys, "_stretch", -1)).alias(f"_before_{n}") for n, (kind, _, _) in sums.items()])
    before = cut(before.filter("_stretch > 0"))
    met = stretched.join(small_side(before, before.count()), list(parts), "left")
    for n, (kind, _, last) in sums.items():
        aggregate, combine = _COMBINED[kind]
        own = aggregate(f"_of_{n}").over(frame(parts, order, last))
        met = met.withColumn(n, combine(F.coalesce(own, F.lit(0)) if kind != "max" else own, F.col(f"_before_{n}")))
    return met.drop("_stretch", *[f"_of_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, words of each turn of each rebuilt conversation, and a row of depth 0 for each: a and b are
    hashes of role and text.

    Turns of one place are ordered by these hashes; repeated rows are turns of their own. Rows without a
    conv_id take no part. Texts go no further than this.
    """
    role, text = utf8("role"), utf8()
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit("a"), role, text).alias("a"), F.xxhash64(F.lit("b"), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    numbered, _ = number_rows(turns, "conv_id", "turn", "a", "b")
    convs = numbered.groupBy("conv_id").agg(F.min("row_num").alias("first"), F.count("*").alias("n_turns"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    bases = convs.filter("conv_id = base").select("base", F.col("n_turns").alias("base_turns"))
    convs = cut(convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_turns", F.lit(0)))).select("conv_id", "base", "first", "h", "lent"))
    met = numbered.join(small_side(convs, convs.count()), "conv_id").withColumn("place", F.col("row_num") - F.col("first") + 1)
    own = met.filter("place > h").select("conv_id", (F.col("lent") + F.col("place") - F.col("h")).alias("depth"), "a", "b", "words")
    heads = met.filter((F.col("conv_id") == F.col("base")) & (F.col("place") < BORROWED)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "a", "b", "words")
    lent = convs.filter("lent > 0").select("conv_id", "base", "lent").join(heads, "base").filter("depth <= lent").select("conv_id", "depth", "a", "b", "words")
    roots = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "words")])
    return cut(own.unionByName(lent).unionByName(roots))


def _met(chain: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Each prefix of a conversation with its node; nodes with very many conversations are a broadcast side."""
    keys, least = ["depth", "k1", "k2"], max(HOT, rows // HOT_NODES)
    hot = nodes.filter(F.col("n_convs") > least)
    n_hot = hot.count()
    if not n_hot:
        return chain.join(nodes, keys)
    met = small_side(hot, n_hot)
    return chain.join(met, keys).unionByName(chain.join(met.select(*keys), keys, "left_anti").join(nodes.filter(F.col("n_convs") <= least), keys))


def trie(chain: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, words, level, head_conv, head_depth), the end of each
    conversation (conv_id, node_conv, depth), and the greatest depth."""
    most = chain.agg(F.max("depth")).first()[0] or 0
    salted = lambda k: F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "a", "b")).otherwise(0)
    keyed = running(chain.select("conv_id", "depth", "words", salted(1).alias("x1"), salted(2).alias("x2")), ("conv_id",), "depth", most, k1=("xor", F.col("x1"), 0), k2=("xor", F.col("x2"), 0))
    keyed = cut(keyed.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words"))
    nodes = cut(keyed.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("node_conv"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "words")]))
    below = nodes.filter("depth > 0").groupBy("depth", "p1", "p2").agg(F.count("*").alias("n_children"), F.max_by(F.struct("k1", "k2"), F.struct("n_convs", -F.col("node_conv"))).alias("heavy"))
    below = cut(below)
    children = below.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    heavy = below.select("depth", "heavy.k1", "heavy.k2", F.lit(0).alias("light"))
    keys = ["depth", "k1", "k2"]
    nodes = nodes.join(children, keys, "left").join(heavy, keys, "left")
    nodes = cut(nodes.select(*keys, "node_conv", "n_convs", "words", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("light", (F.col("depth") > 0).cast("int")).alias("light")))
    placed = _met(keyed.select("conv_id", *keys), nodes, keyed.count()).drop("k1", "k2")
    begins = (F.col("light") == 1) | (F.col("depth") == 0)
    placed = running(
        placed, ("conv_id",), "depth", most,
        level=("sum", F.col("light").cast("long"), 0), head_conv=("max", F.when(begins, F.col("node_conv")), 0), head_depth=("max", F.when(begins, F.col("depth")), 0), parent_conv_id=("max", F.col("node_conv"), -1),
    )
    placed = written(placed)
    ends = placed.groupBy("conv_id").agg(F.max("node_conv").alias("node_conv"), F.max("depth").alias("depth"))
    own = placed.filter("conv_id = node_conv").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "words", "level", "head_conv", "head_depth")
    return own, ends, most


def with_totals(nodes: DataFrame, most: int) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of their subtrees: a round for each number of light nodes on the way down."""
    nodes = written(nodes.repartition("level", "head_conv", "head_depth"))
    levels = nodes.agg(F.max("level")).first()[0]
    done, added = None, None
    for level in range(-1 if levels is None else levels, -1, -1):
        rows = nodes.filter(F.col("level") == level)
        rows = rows.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words"), "up": F.lit(most) - F.col("depth")})
        if added is not None:
            rows = rows.join(added, ["conv_id", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("_saved", F.lit(0))})
        summed = running(rows, ("head_conv", "head_depth"), "up", most, n_leaves=("sum", F.col("leaf"), 0), saved_tokens=("sum", F.col("saved"), 0))
        summed = written(summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "head_conv", "head_depth"))
        heads = summed.filter("conv_id = head_conv and depth = head_depth and depth > 0")
        added = heads.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        done = summed if done is None else done.unionByName(summed)
    if done is None:
        return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *[F.lit(0).cast("long").alias(c) for c in ("n_leaves", "saved_tokens")])
    return done.drop("head_conv", "head_depth")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's strings in their order, fed one after the other."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (conv, depth) != key:
                if key is not None:
                    yield row()
                key, digest = (conv, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of each node at which conversations end. A node's ids are ordered by a range shuffle and
    joined to strings of ``CHUNK`` ids, which alone meet in one task."""
    numbered, _ = number_rows(ends, "node_conv", "depth", "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = numbered.groupBy("node_conv", "depth", F.floor(F.col("row_num") / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    dealt = parts.repartition("node_conv", "depth").sortWithinPartitions("node_conv", "depth", "chunk")
    return dealt.select("node_conv", "depth", "ids").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of the
    rebuilt conversations (:func:`rebuilt_turns`).

    A null role or text is empty; a conversation without turns is a member of the root, which is there
    unless the table has no conversation at all (then there are no rows).
    """
    nodes, ends, most = trie(rebuilt_turns(conversations))
    out = with_totals(nodes, most).join(end_digests(ends), ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_PREFIX_TRIE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
           lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY conv_id
), l AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lent FROM c LEFT JOIN c b ON b.conv_id = c.base
), r AS (
  SELECT l.conv_id, lent + pos - h AS depth, role, text FROM l JOIN t ON t.conv_id = l.conv_id WHERE pos > h
  UNION ALL SELECT l.conv_id, pos, role, text FROM l JOIN t ON t.conv_id = l.base WHERE pos <= lent
), p AS (
  SELECT conv_id, depth, text, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r
  UNION ALL SELECT conv_id, 0, '', '' FROM l
), e AS (
  SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id
), n AS (
  SELECT key, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')) AS saved,
         coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = last), '') AS ids
  FROM p JOIN e ON e.conv_id = p.conv_id GROUP BY key, p.depth
), k AS (
  SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND starts_with(m.key, n.key)) AS n_children FROM n
), s AS (
  SELECT a.key, a.depth, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
  FROM k a JOIN k b ON b.depth >= a.depth AND starts_with(b.key, a.key) GROUP BY a.key, a.depth
)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM k JOIN s ON s.key = k.key AND s.depth = k.depth LEFT JOIN k u ON u.depth = k.depth - 1 AND u.key = k.key[1:length(k.key) - 32]
"""
