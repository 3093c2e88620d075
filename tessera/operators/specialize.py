"""Specializations of templates: subsets of instances with a fixed value or two equal parameters.

A node is a template restricted to the instances that agree on something, simplified; it is known
by its text. Nodes are found level by level, all templates at once: the instances of each node of a
level are dealt to its candidates (parameter and value, or pair of parameters), candidates below the
thresholds go before their children are looked at, and the rest is simplified and told apart by
text. An edge to a node that is also reached through another child is left out at the end.

Texts are long, so while nodes are searched two 64-bit hashes stand for them, and only counts and
fingerprints are shuffled by candidate; rows of instances move only to nodes that have parameters left. Each
text is written out once at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import few, stored, transitive_reduction
from tessera.operators.lattice import bound_values, general_text

_CANDIDATE, _NODE, _PARENT = ["c1", "c2"], ["n1", "n2"], ["p1", "p2"]


@dataclass(frozen=True)
class Forest:
    """``base``: the instances; ``named``: the nodes with their text and hashes; ``links``: candidates' parents and nodes as
    hashes; ``open_rows``: the instances of nodes with parameters; ``keys``."""

    base: DataFrame
    named: DataFrame
    links: DataFrame
    open_rows: DataFrame
    keys: tuple[str, ...]

    @property
    def nodes(self) -> DataFrame:
        """keys, template, node, depth, num_instances, num_exec, n_params, and t_first, t_last, sum_log2_exec."""
        return self.named.drop(*_NODE, "pieces", "t")

    @cached_property
    def reduced(self) -> DataFrame:
        """p1, p2, n1, n2: the edges without those that a longer way replaces."""
        ends = self.links.select(F.struct(*_PARENT).alias("parent"), F.struct(*_NODE).alias("node"))
        return transitive_reduction(ends, "parent", "node").select(*[F.col(f"parent.{c}") for c in _PARENT], *[F.col(f"node.{c}") for c in _NODE])

    @property
    def edges(self) -> DataFrame:
        """keys, parent, node: texts."""
        text = self.named.select(*_NODE, *self.keys, "node")
        above = text.select(*[F.col(n).alias(p) for n, p in zip(_NODE, _PARENT)], F.col("node").alias("parent"))
        return self.reduced.join(above, _PARENT).join(text, _NODE).select(*self.keys, "parent", "node")

    @cached_property
    def rows(self) -> DataFrame:
        """n1, n2, t, depth, slots and the instance's columns: the instances of every node. Those of a node without parameters
        are the instances with its constants."""
        whole = self.named.filter("n_params = 0").select(*_NODE, "depth")
        leaves = self.base.withColumns(dict(zip(_NODE, _whole()))).join(whole, _NODE)
        leaves = leaves.withColumn("slots", F.transform("bindings", lambda v: F.lit(-1)))
        return self.open_rows.unionByName(leaves.select(*self.open_rows.columns))

    @property
    def members(self) -> DataFrame:
        """The instances of every node with their reduced bindings."""
        node = self.named.select(*_NODE, *self.keys, "template", "node")
        return self.rows.join(node, _NODE).withColumn("bindings", bound_values(F.col("slots"), F.col("bindings"))).drop(*_NODE, "t", "slots", "depth")


def _twice(*columns: Column | str) -> list[Column]:
    return [F.xxhash64(F.lit(k), *columns) for k in (1, 2)]


def _whole() -> list[Column]:
    """The hashes of an instance's own text, without parameters."""
    return _twice("t", "bindings")


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _value(k: Column) -> Column:
    """The value of a parameter: that of its first position."""
    return F.element_at("bindings", F.array_position("slots", k).cast("int"))


def _parameters() -> Column:
    return F.sequence(F.lit(0), F.array_max("slots"))


def children(level: DataFrame) -> DataFrame:
    """The rows of a level once for each candidate (c1, c2) below their node, which becomes p1, p2."""
    both = lambda *columns: F.struct(*[c.alias(name) for c, name in zip(_twice(*_NODE, *columns), _CANDIDATE)])
    fixed = F.transform(_parameters(), lambda k: both(k, _value(k)))
    equal = F.flatten(
        F.transform(_parameters(), lambda i: F.transform(F.filter(_parameters(), lambda j: (j > i) & (_value(i) == _value(j))), lambda j: both(F.lit("~"), i, j)))
    )
    dealt = level.select("*", F.explode(F.concat(fixed, equal)).alias("_c"))
    return dealt.select("*", *[F.col(f"_c.{c}") for c in _CANDIDATE]).drop("_c").withColumnsRenamed(dict(zip(_NODE, _PARENT)))


def _simplified(rows: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """c1, c2, marks: for each parameter of the parent whether the candidate's instances agree on it, the hashes of its constants
    then, and the fingerprint of its values."""
    at = lambda k, salt: _xor(F.transform("bindings", lambda v, i: F.when(F.get("slots", i) == k, F.xxhash64(F.lit(salt), i, v)).otherwise(F.lit(0).cast("long"))))
    each = F.transform(_parameters(), lambda k: F.struct(k.alias("k"), at(k, 1).alias("a"), at(k, 2).alias("b"), _value(k).alias("v")))
    spots = rows.join(few(candidates.select(*_CANDIDATE), n), _CANDIDATE).select(*_CANDIDATE, "instance", F.explode(each).alias("s")).select(*_CANDIDATE, "instance", "s.*")
    h = F.xxhash64("instance", "v")
    marks = spots.groupBy(*_CANDIDATE, "k").agg(
        ((F.min("a") == F.max("a")) & (F.min("b") == F.max("b"))).alias("same"),
        F.min("a").alias("a"),
        F.min("b").alias("b"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("high"),
        F.bit_xor(F.xxhash64("v", "instance")).alias("x"),
    )
    return marks.groupBy(*_CANDIDATE).agg(F.array_sort(F.collect_list(F.struct("k", "same", "a", "b", "low", "high", "x"))).alias("marks"))


def _found(rows: DataFrame, parents: DataFrame, n_parents: int, min_instances: int, min_executions: int) -> DataFrame:
    """The candidates of ``rows`` that pass the thresholds, each with its node: n1, n2, n_params, the columns of ``parents`` anew,
    the sums over its instances and the number ``one`` of an instance."""
    times = [f(c).alias(c) for c, f in (("t_first", F.min), ("t_last", F.max)) if c in rows.columns]
    logs = F.sum(F.when(F.col("num_exec") > 0, F.log2("num_exec"))).alias("sum_log2_exec")
    marked = rows.withColumns(dict(zip(("w1", "w2"), _whole())))
    ends = [F.min("w1").alias("w1"), F.min("w2").alias("w2"), (F.min("w1") == F.max("w1")).alias("whole")]
    sums = marked.groupBy(*_CANDIDATE, *_PARENT).agg(F.count("*").alias("num_instances"), F.sum("num_exec").alias("num_exec"), *times, logs, F.max("instance").alias("one"), *ends)
    if min_instances > 1 or min_executions > 0:
        sums = sums.filter((F.col("num_instances") >= min_instances) & (F.col("num_exec") >= min_executions))
    sums = stored(sums)
    carried = [c for c in sums.columns if c not in ("w1", "w2", "whole")]
    several = sums.filter(~F.col("whole"))
    n = several.count()
    prints = lambda m: F.struct(m["low"], m["high"], m["x"])
    seen = F.array_distinct(F.transform(F.filter("marks", lambda m: ~m["same"]), prints))
    told = several.join(few(_simplified(rows, several, n), n), _CANDIDATE).join(few(parents, n_parents), _PARENT).withColumn("seen", seen)
    to = F.transform("marks", lambda m: F.when(m["same"], -1).otherwise(F.array_position("seen", prints(m)).cast("int") - 1))
    agreed = lambda c: _xor(F.transform(F.filter("marks", lambda m: m["same"]), lambda m: m[c]))
    told = told.withColumn("to", to).withColumns(
        {"slots": F.transform("slots", lambda s: F.when(s < 0, -1).otherwise(F.get("to", s))), "r1": F.col("r1").bitwiseXOR(agreed("a")), "r2": F.col("r2").bitwiseXOR(agreed("b"))}
    )
    told = told.withColumn("n_params", F.size("seen")).withColumns(dict(zip(_NODE, _twice("t", "slots", "r1", "r2"))))
    others = ["t", "slots", "r1", "r2"]
    told = told.select(*carried, *_NODE, "n_params", *others)
    alone = sums.filter("whole").select(*carried, F.col("w1").alias("n1"), F.col("w2").alias("n2"), F.lit(0).alias("n_params"), *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in others])
    return stored(told.unionByName(alone))


def grow_forest(instances: DataFrame, min_instances: int = 2, min_executions: int = 1, max_levels: int | None = None, keys: tuple[str, ...] = ()) -> Forest:
    """The forest of each combination of ``keys`` (dataset, cluster), all of them in one job.

    ``instances`` as :func:`tessera.operators.templates.generalize` makes them, with num_exec. Roots are
    the simplified templates. Nodes may have several parents. Growth is exponential in the number of
    parameters and held by the thresholds; it ends as each level has fewer parameters than the one
    above. With ``max_levels`` it ends there at the latest.
    """
    carried = ["instance", "num_exec", *[c for c in ("id", "t_first", "t_last") if c in instances.columns], "pre"]
    pre = F.xxhash64("preamble") if "preamble" in instances.columns else F.lit(None).cast("long")
    of = [x for k in keys for x in (F.col(k), F.col(k).isNull())]  # hashes skip nulls
    base = instances.withColumns({"pre": pre, "t": F.xxhash64(*of, "template")})
    first = dict(zip(_PARENT, _twice(*of, "template")))
    # each position of a template its own parameter, below a parent that stands for the template
    start = F.transform("bindings", lambda v, i: i)
    rows = base.select("t", *carried, "bindings", start.alias("slots"), *[c.alias(p) for p, c in first.items()], *[c.alias(k) for k, c in zip(_CANDIDATE, first.values())])
    zero = F.lit(0).cast("long")
    parents = stored(rows.select(*_PARENT, "t", "slots", zero.alias("r1"), zero.alias("r2")).distinct())
    levels, links, open_rows = [], [], []
    for depth in count(0):
        found = _found(rows, parents, parents.count(), *((min_instances, min_executions) if depth else (0, 0)))
        if depth:
            links.append(found.select(*_PARENT, *_NODE))
        # a text stands for the same instances however it was reached
        same = [f(c).alias(c) for c, f in (("num_instances", F.max), ("num_exec", F.max), ("t_first", F.min), ("t_last", F.max), ("sum_log2_exec", F.max), ("one", F.max)) if c in found.columns]
        fresh = found.groupBy(*_NODE, "n_params", "t", "slots", "r1", "r2").agg(*same, F.min("c1").alias("c1"))
        for known in levels:
            fresh = fresh.join(known.select(*_NODE), _NODE, "left_anti")
        fresh = stored(fresh.withColumn("depth", F.lit(depth)))
        levels.append(fresh)
        below = fresh.filter("n_params > 0")
        n = below.count()
        chosen = found.filter("n_params > 0").select(*_CANDIDATE, *_NODE).join(few(below.select(*_NODE, "c1", F.col("slots").alias("_slots")), n), [*_NODE, "c1"])
        kept = rows.join(few(chosen, n), _CANDIDATE).select(*_NODE, "t", F.col("_slots").alias("slots"), F.lit(depth).alias("depth"), *carried, "bindings")
        open_rows.append(stored(kept) if n else kept.limit(0))
        if n == 0 or depth == max_levels:
            break
        rows, parents = children(open_rows[-1]), below.select(*[F.col(c).alias(p) for c, p in zip(_NODE, _PARENT)], "t", "slots", "r1", "r2")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    nodes = union(levels)
    sums = [c for c in ("depth", "num_instances", "num_exec", "n_params", "t_first", "t_last", "sum_log2_exec") if c in nodes.columns]
    texts = base.select(*keys, "template", "pieces", "bindings", "t", F.col("instance").alias("one")).join(few(nodes.drop("t"), nodes.count()), "one")
    vector = F.coalesce("slots", F.transform("bindings", lambda v: F.lit(-1)))
    named = texts.select(*keys, "template", general_text(F.col("pieces"), F.col("bindings"), vector).alias("node"), *sums, *_NODE, "t", F.when(F.col("depth") == 0, F.col("pieces")).alias("pieces"))
    if not base.groupBy("instance").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        named = named.dropDuplicates(_NODE)  # equal rows share their instance
    nothing = nodes.limit(0).select(*[F.col(n).alias(p) for n, p in zip(_NODE, _PARENT)], *_NODE)
    return Forest(base, stored(named), union(links) if links else nothing, union(open_rows), keys)


def specialization_forest(
    instances: DataFrame, min_instances: int = 2, min_executions: int = 1, max_levels: int | None = None, keys: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of :func:`grow_forest`."""
    forest = grow_forest(instances, min_instances, min_executions, max_levels, keys)
    return forest.nodes, forest.edges
