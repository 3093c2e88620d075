"""Generalizations of queries: partial partitions of their constants' positions.

Positions of equal constants form a cluster; a block (a parameter) never mixes clusters, and a
position in no block keeps its constant.

:func:`supported_generalizations` finds those of a log that matter, from the most general texts downwards: a
text that fails the thresholds is not refined, as a less general one never has more instances, and a
position where all instances of a text agree keeps its constant at once, as no parameter there ever
diverges below. :func:`generalizations` lists all of a query, whatever their support; families depend on
the shape of a query alone, so they are enumerated once for each distinct shape.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import parameter_label
from tessera.operators.graph import few, join_by, stored
from tessera.operators.tokenizer import TokenOptions, decompose

_FAMILY = "vector array<int>, subsets array<array<int>>, reductions array<array<int>>"


def _partial_partitions(items: list[int], most: int) -> Iterator[list[list[int]]]:
    """Ways to put some of the items into at most ``most`` blocks."""
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for blocks in _partial_partitions(rest, most):
        yield blocks
        if len(blocks) < most:
            yield [[first], *blocks]
        for i in range(len(blocks)):
            yield [*blocks[:i], [first, *blocks[i]], *blocks[i + 1 :]]


def families(clusters: list[list[int]], max_subsets: int | None = None) -> list[list[list[int]]]:
    """All families of blocks over the clusters, blocks by their first position; the empty family first."""
    most = sum(map(len, clusters)) if max_subsets is None else max_subsets
    found: list[list[list[int]]] = [[]]
    for cluster in clusters:
        found = [a + b for a in found for b in _partial_partitions(sorted(cluster), most) if len(a) + len(b) <= most]
    return sorted((sorted(f) for f in found), key=lambda f: (len(f), sum(map(len, f)), f))


def family_vector(family: list[list[int]], n: int) -> list[int]:
    """Block of each position, -1 for a kept constant."""
    out = [-1] * n
    for k, block in enumerate(family):
        for position in block:
            out[position] = k
    return out


def one_step_up(clusters: list[list[int]], family: list[list[int]], known: set[str]) -> list[list[int]]:
    """Vectors of the families that are one step more general: a kept position becomes a block of its own or
    joins one of its cluster, or a block gives one part away."""
    n = sum(map(len, clusters))
    used = {p for b in family for p in b}
    out = []
    for cluster in clusters:
        for p in cluster:
            if p not in used:
                out.append([*family, [p]])
                out += [[*family[:i], [*b, p], *family[i + 1 :]] for i, b in enumerate(family) if b[0] in cluster]
    for i, b in enumerate(family):
        first, rest = b[0], b[1:]
        for mask in range(1 << len(rest)):
            part = [x for k, x in enumerate(rest) if mask >> k & 1]
            if part:
                out.append([*family[:i], [first, *(x for x in rest if x not in part)], part, *family[i + 1 :]])
    vectors = {str(v): v for f in out for v in [family_vector(sorted(sorted(b) for b in f), n)]}
    return [v for k, v in sorted(vectors.items()) if k in known]


@F.udtf(returnType=_FAMILY)
class Families:
    """One row for each family of a shape (array: for each position the first position with an equal constant)."""

    def eval(self, shape: list, max_subsets: int):
        clusters: dict[int, list[int]] = {}
        for position, first in enumerate(shape or []):
            clusters.setdefault(first, []).append(position)
        groups = list(clusters.values())
        found = families(groups, None if max_subsets is None or max_subsets < 0 else max_subsets)
        n = len(shape or [])
        vectors = [family_vector(f, n) for f in found]
        known = {str(v) for v in vectors}
        for f, v in zip(found, vectors):
            yield v, f, one_step_up(groups, f, known)


def general_text(pieces: Column, constants: Column, vector: Column, sparql: bool = True) -> Column:
    """The text with a parameter for each block of the vector and the constants that are kept (-1)."""
    slots = F.zip_with(constants, vector, lambda c, v: F.when(v < 0, c).otherwise(parameter_label(v, sparql)))
    tail = F.zip_with(slots, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: F.concat(a, b))
    return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))


def _blocks(vector: Column) -> Column:
    """The blocks of a vector in order of their first positions."""
    return F.array_distinct(F.filter(vector, lambda v: v >= 0))


def _numbered(vector: Column) -> Column:
    """The vector with its blocks numbered from 0 in order of their first positions."""
    return F.transform(vector, lambda v: F.when(v < 0, -1).otherwise(F.array_position(_blocks(vector), v) - 1).cast("int"))


def _first(vector: Column, block: Column) -> Column:
    return F.array_position(vector, block).cast("int")


def bound_values(vector: Column, constants: Column) -> Column:
    """The constant of each block, in order of the blocks' first positions."""
    return F.transform(_blocks(vector), lambda b: F.element_at(constants, _first(vector, b)))


def _merges(vector: Column, constants: Column) -> Column:
    """The vectors in which two blocks of equal constants are one."""
    value = lambda b: F.element_at(constants, _first(vector, b))
    into = lambda a, b: F.transform(vector, lambda v: F.when(v == b, a).otherwise(v))
    of = lambda a: F.transform(F.filter(_blocks(vector), lambda b: (b > a) & (value(a) == value(b))), lambda b: into(a, b))
    return F.flatten(F.transform(_blocks(vector), of))


def _kept_more(vector: Column, alone: bool) -> Column:
    """The vectors in which one position more keeps its constant; with ``alone`` only positions that are a block."""
    free = F.filter(F.sequence(F.lit(0), F.size(vector) - 1), lambda p: F.get(vector, p) >= 0)
    if alone:
        free = F.filter(free, lambda p: F.size(F.filter(vector, lambda v: v == F.get(vector, p))) == 1)
    return F.transform(free, lambda p: F.transform(vector, lambda v, i: F.when(i == p, -1).otherwise(v)))


_KEYS = ["k1", "k2"]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with two hashes that stand for the text of pieces (by their hash t), constants and vector: texts are long, and only
    those that are left in the end are written out."""
    shown = rows.withColumn("_shown", F.zip_with("constants", "vector", lambda c, v: F.when(v < 0, c)))
    return shown.withColumns({k: F.xxhash64(F.lit(k), "t", "vector", "_shown") for k in _KEYS}).drop("_shown")


_WAY = ["above", "step", "value"]


def _steps(texts: DataFrame) -> DataFrame:
    """above (k1 of the text), step, at, a, b, vector: the vectors one step below each text. A block of one position ``at`` keeps its
    constant, or the blocks that begin at ``a`` and ``b`` become one where their constants are equal."""
    vector, blocks = F.col("vector"), _blocks(F.col("vector"))
    none = F.lit(None).cast("int")
    step = lambda at, a, b, v: F.struct(at.alias("at"), a.alias("a"), b.alias("b"), _numbered(v).alias("vector"))
    alone = F.filter(F.sequence(F.lit(0), F.size(vector) - 1), lambda p: (F.get(vector, p) >= 0) & (F.size(F.filter(vector, lambda v: v == F.get(vector, p))) == 1))
    kept = F.transform(alone, lambda p: step(p, none, none, F.transform(vector, lambda v, i: F.when(i == p, -1).otherwise(v))))
    into = lambda a, b: F.transform(vector, lambda v: F.when(v == b, a).otherwise(v))
    merged = F.flatten(F.transform(blocks, lambda a: F.transform(F.filter(blocks, lambda b: b > a), lambda b: step(none, _first(vector, a) - 1, _first(vector, b) - 1, into(a, b)))))
    return texts.select(F.col("k1").alias("above"), F.posexplode(F.concat(kept, merged)).alias("step", "s")).select("above", "step", "s.*")


def _level(rows: DataFrame, base: DataFrame, steps: DataFrame | None, seen: DataFrame | None, min_instances: int, min_executions: int) -> tuple[DataFrame, DataFrame, int]:
    """Texts (k1, k2, t, vector, constants and number ``one`` of an instance, num_instances, num_exec) that pass the thresholds and
    are not ``seen``, positions where all their instances agree keeping their constants; the instances of each; the texts' number.

    ``rows`` have above, step, value (a way to a text), instance, num_exec, constants; ``steps`` the vectors of steps. All ways to a text give the same
    instances, so vectors are worked on and one way is chosen by text; of rows, constants are counted only.
    """
    counts = rows.groupBy(*_WAY).agg(F.count("*").alias("num_instances"), F.coalesce(F.sum("num_exec"), F.lit(0)).alias("num_exec"), F.max("instance").alias("one"))
    ways = stored(counts.filter((F.col("num_instances") >= min_instances) & (F.col("num_exec") >= min_executions)))
    n = ways.count()
    ends = base.select(F.col("instance").alias("one"), "t", "constants").join(few(ways.select("one").distinct(), n), "one")
    told, n_steps = ways.join(few(ends, n), "one"), steps.count() if steps is not None else 0
    if steps is None:  # the first level: a parameter for each constant
        told = told.withColumn("vector", F.transform("constants", lambda c, i: i))
    else:
        told = told.join(few(steps.select("above", "step", "vector"), n_steps), ["above", "step"])
    told = stored(told)
    free = F.filter(F.transform("vector", lambda v, i: F.when(v >= 0, i)), lambda i: i.isNotNull())
    spots = _by_way(rows, told.select(*_WAY, F.col("constants").alias("_c"), free.alias("_free")), n).select(*_WAY, "constants", "_c", F.explode("_free").alias("at"))
    # the value of one instance is the value of all or not
    agree = spots.groupBy(*_WAY, "at").agg(F.min(F.get("constants", "at") == F.get("_c", "at")).alias("_same")).filter("_same")
    agreed = agree.groupBy(*_WAY).agg(F.collect_set("at").alias("_agreed"))
    held = join_by(told, agreed, _WAY, "left").withColumn("vector", F.when(F.col("_agreed").isNull(), F.col("vector")).otherwise(_numbered(F.transform("vector", lambda v, i: F.when(F.array_contains("_agreed", i), -1).otherwise(v))))).drop("_agreed")
    texts = _keyed(held.filter(F.exists("vector", lambda v: v >= 0))).dropDuplicates(_KEYS)
    if seen is not None:
        texts = texts.join(seen, _KEYS, "left_anti")
    texts = stored(texts)
    return texts, stored(_by_way(rows, texts.select(*_WAY, *_KEYS), n).select(*_KEYS, "instance", "num_exec", "constants")), texts.count()


def _by_way(rows: DataFrame, ways: DataFrame, n: int) -> DataFrame:
    return join_by(rows, few(ways, n), _WAY)


def supported_generalizations(queries: DataFrame, options: TokenOptions = TokenOptions(), max_vars: int = 3, min_instances: int = 0, min_executions: int = 0, include_identity: bool = False) -> tuple[DataFrame, DataFrame]:
    """The texts of the generalizations with at most ``max_vars`` parameters (with ``include_identity`` also without) that pass the
    thresholds: k1, k2 (they stand for the text), num_instances, num_exec, t, pieces, constants (of one instance), vector, one;
    and their instances: k1, k2, instance, num_exec, constants.

    Texts with a parameter that has one value in all their instances may be left out: they do not diverge. Levels
    go down from one parameter a constant, by one parameter each: a parameter gets a constant, or two become one.
    Every level is a stored table, and a text is looked at once, however it was reached.
    """
    found = queries.filter("text is not null").withColumn("_d", decompose(F.col("text"), options))
    cut = stored(found.select(F.xxhash64(*queries.columns).alias("instance"), "num_exec", F.xxhash64("_d.pieces").alias("t"), F.col("_d.pieces").alias("pieces"), F.col("_d.constants").alias("constants")))
    once = cut
    if not cut.groupBy("instance").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        once = stored(cut.dropDuplicates(["instance"]))  # equal rows share their instance
    base = once.drop("pieces")
    first = base.filter(F.size("constants") > 0).select(F.col("t").alias("above"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("value"), "instance", "num_exec", "constants")
    columns, blocks = [*_KEYS, "num_instances", "num_exec", "t", "constants", "vector", "one"], F.size(_blocks(F.col("vector")))
    texts, rows, n = _level(first, base, None, None, min_instances, min_executions)
    texts_, rows_, seen = texts.select(*columns), rows, texts.select(*_KEYS)
    while n:
        # what has one parameter has nothing below it but queries
        steps = stored(_steps(texts.filter(blocks > 1)))
        n = steps.count()
        if n == 0:
            break
        dealt = rows.withColumnRenamed("k1", "above").join(few(steps, n), "above").filter("at is not null or get(constants, a) = get(constants, b)")
        below = dealt.select("above", "step", F.get("constants", "at").alias("value"), "instance", "num_exec", "constants")
        texts, rows, n = _level(below, base, steps, seen, min_instances, min_executions)
        seen, texts_, rows_ = seen.unionByName(texts.select(*_KEYS)), texts_.unionByName(texts.select(*columns)), rows_.unionByName(rows)
    texts_ = texts_.filter(blocks <= max_vars)
    if include_identity:
        whole = _keyed(cut.drop("pieces").withColumn("vector", F.transform("constants", lambda v: F.lit(-1))))
        sums = [F.count("*").alias("num_instances"), F.coalesce(F.sum("num_exec"), F.lit(0)).alias("num_exec"), F.max("instance").alias("one")]
        counts = whole.groupBy(*_KEYS).agg(*sums).filter((F.col("num_instances") >= min_instances) & (F.col("num_exec") >= min_executions))
        of = whole.select(*_KEYS, "t", "constants", "vector").dropDuplicates(_KEYS)
        texts_ = texts_.unionByName(counts.join(of, _KEYS).select(*columns))
        rows_ = rows_.unionByName(whole.select(*rows.columns))
    texts_ = stored(texts_)
    n = texts_.count()
    pieces = cut.select("t", "pieces").join(few(texts_.select("t").distinct(), n), "t", "left_semi").dropDuplicates(["t"])
    return stored(texts_.join(few(pieces, n), "t")), rows_.join(few(texts_.select(*_KEYS), n), _KEYS, "left_semi")


def supported_edges(general: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (child, parent) between kept texts (k1, k2, template, t, vector, one) of :func:`supported_generalizations`, and the
    roots. One step down a parameter that stands once gets its constant, one of several places of a parameter does, or two
    parameters become one. A child's instances are all its parents', so one of them shows these, but for parents with a parameter in
    several places: what they share with a child is looked up in all their instances."""
    n, texts, above = kept.count(), kept.select(*_KEYS, "template"), dict(zip(_KEYS, ("p1", "p2")))
    vector = F.col("vector")
    steps = F.explode(F.array_distinct(F.transform(F.concat(_kept_more(vector, False), _merges(vector, F.col("constants"))), _numbered)))
    parents, placed = kept.select(*_KEYS, "t", "vector"), F.filter(vector, lambda v: v >= 0)
    shown = general.join(few(kept.select(F.col("one").alias("instance")).distinct(), n), "instance").join(few(parents, n), _KEYS)
    spread = general.join(few(parents.filter(F.size(placed) > F.size(_blocks(vector))), n), _KEYS)
    rows = shown.select(*_KEYS, "t", "vector", "constants").unionByName(spread.select(*_KEYS, "t", "vector", "constants")).withColumnsRenamed(above)
    pairs = _keyed(rows.select("p1", "p2", "t", "constants", steps.alias("vector"))).select(*_KEYS, "p1", "p2").distinct()
    edges = pairs.join(few(texts.withColumnRenamed("template", "child"), n), _KEYS).join(few(texts.withColumnsRenamed(above | {"template": "parent"}), n), ["p1", "p2"])
    edges = edges.select("child", "parent").distinct()
    return edges, texts.select(F.col("template").alias("general")).join(edges.select(F.col("child").alias("general")), "general", "left_anti")


def generalizations(queries: DataFrame, options: TokenOptions = TokenOptions(), max_vars: int = 3, include_identity: bool = False) -> DataFrame:
    """The query's columns with ``general`` (text), ``bindings`` and ``more_general`` (texts one step up).

    Without ``include_identity`` the query itself, without parameters, is left out.
    """
    spark = queries.sparkSession
    name = f"families_{uuid.uuid4().hex}"
    spark.udtf.register(name, Families)
    found = queries.filter("text is not null").withColumn("_d", decompose(F.col("text"), options))
    constants = F.col("_d.constants")
    found = found.withColumn("_shape", F.transform(constants, lambda c: (F.array_position(constants, c) - 1).cast("int")))
    listed = spark.sql(f"SELECT s._shape AS _s, f.* FROM {{shapes}} s, LATERAL {name}(s._shape, {int(max_vars)}) f", shapes=found.select("_shape").distinct())
    if not include_identity:
        listed = listed.filter(F.exists("vector", lambda v: v >= 0))
    joined = found.join(listed, F.col("_shape") == F.col("_s"))
    text = lambda vector: general_text(F.col("_d.pieces"), constants, vector, options.sparql_parameters)

    return joined.select(
        *queries.columns,
        text(F.col("vector")).alias("general"),
        F.transform("subsets", lambda b: F.element_at(constants, b[0] + 1)).alias("bindings"),
        F.transform("reductions", text).alias("more_general"),
    )


def generalization_edges(general: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (child, parent) between kept generalizations (``general`` texts), and the roots, which have no parent left."""
    pairs = general.select(F.col("general").alias("child"), F.explode("more_general").alias("parent")).distinct()
    texts = kept.select("general").distinct()
    edges = pairs.join(texts.withColumnRenamed("general", "child"), "child", "left_semi").join(texts.withColumnRenamed("general", "parent"), "parent", "left_semi").select("child", "parent")
    return edges, texts.join(edges.select(F.col("child").alias("general")), "general", "left_anti")
