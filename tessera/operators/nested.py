"""Forests as nested values: each node a variant with its specializations inside.

The fold goes from the leaves up, by the number of parameters, which falls along every edge. Sizes are
added up before anything is gathered: a node whose value would hold more than ``most_nodes`` nodes is
not nested. Its children begin rows of their own that name it, so no value outgrows the bound
and no node is lost. A node with several parents is found below each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import join_by, stored

#: Nodes that one nested value holds at most.
MOST_NODES = 50_000


def _value(fields: list[str], children: Column | None) -> Column:
    """The node as a variant object; ``children`` has (node, value) structs or is null."""
    parts = [F.col(f) for f in fields]
    return F.to_variant_object(F.struct(*parts) if children is None else F.struct(*parts, children.alias("specializations")))


def _inside(as_array: bool) -> Column:
    """The children in the order of their texts, as an array or as an object by text."""
    order = lambda a, b: F.when(a["node"] < b["node"], -1).when(a["node"] > b["node"], 1).otherwise(0)
    inside = F.array_sort("_children", order)
    values = F.transform(inside, lambda c: c["value"])
    return values if as_array else F.to_variant_object(F.map_from_arrays(F.transform(inside, lambda c: c["node"]), values))


def nested_forest(
    nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = (), as_array: bool = True, only_roots: bool = False, most_nodes: int = MOST_NODES
) -> DataFrame:
    """keys, node, under, n_nodes, nested, value: a row for each root, and for each child of a node too large to nest.

    ``nodes`` and ``edges`` as :func:`tessera.operators.specialize.grow_forest` makes them. ``under`` is the
    node that a row belongs to (null for roots), ``n_nodes`` counts the nodes of its tree (at most one
    more than ``most_nodes`` is told), ``nested`` whether they are in ``value``. ``value`` is a variant with node, num_instances,
    num_exec, n_params and specializations: an array in the order of texts, or by ``as_array`` an object by text. With
    ``only_roots`` roots alone are given, without specializations. An empty forest gives no row.
    """
    fields = ["node", "num_instances", "num_exec", "n_params"]
    known = [*keys, "node"]
    if only_roots:
        children = edges.select(*known).distinct()
        return join_by(nodes, children, known, "left_anti").select(
            *known, F.lit(None).cast("string").alias("under"), F.lit(1).cast("long").alias("n_nodes"), F.lit(True).alias("nested"), _value(fields, None).alias("value")
        )
    # one row for each number of parameters that occurs, at most those of the longest query
    levels = [r[0] for r in nodes.select("n_params").distinct().orderBy("n_params").collect()]
    of = nodes.select(*keys, *fields)
    up = stored(join_by(edges.select(*keys, "parent", "node"), nodes.select(*known, F.col("n_params").alias("_parent_params")).withColumnRenamed("node", "parent"), [*keys, "parent"]))
    done = None
    empty = F.array().cast("array<struct<node:string,value:variant>>")
    for level in levels:
        own = of.filter(F.col("n_params") == level)
        if done is None:
            row = own.withColumns({"_children": empty, "n_nodes": F.lit(1).cast("long")})
        else:
            below = join_by(up.filter(F.col("_parent_params") == level).drop("_parent_params"), done.select(*known, "n_nodes", "value"), known)
            sizes = below.groupBy(*keys, "parent").agg((F.sum("n_nodes") + 1).alias("n_nodes"))
            small = sizes.filter(F.col("n_nodes") <= most_nodes).select(*keys, "parent")
            inside = join_by(below, small, [*keys, "parent"], "left_semi").groupBy(*keys, "parent").agg(F.collect_list(F.struct("node", "value")).alias("_children"))
            row = join_by(own, sizes.withColumnRenamed("parent", "node"), known, "left")
            row = join_by(row, inside.withColumnRenamed("parent", "node"), known, "left").withColumns({"_children": F.coalesce("_children", empty), "n_nodes": F.least(F.coalesce("n_nodes", F.lit(1)), F.lit(most_nodes + 1)).cast("long")})
        level_done = stored(row.select(*known, "n_nodes", (F.col("n_nodes") <= most_nodes).alias("nested"), _value(fields, _inside(as_array)).alias("value")))
        done = level_done if done is None else done.unionByName(level_done)
    if done is None:
        return nested_forest(nodes, edges, keys, as_array, True)
    roots = join_by(done, up.select(*known).distinct(), known, "left_anti").withColumn("under", F.lit(None).cast("string"))
    large = done.filter("not nested").select(*keys, F.col("node").alias("parent"))
    cut_off = join_by(done, join_by(up.select(*keys, "parent", "node"), large, [*keys, "parent"], "left_semi").withColumnRenamed("parent", "under"), known)
    columns = [*known, "under", "n_nodes", "nested", "value"]
    return roots.select(*columns).unionByName(cut_off.select(*columns))


def write_nested(forest: DataFrame, path: str, *keys: str) -> None:
    """One JSON line for each row of :func:`nested_forest`, in a folder for each cluster or dataset (``keys``)."""
    out = forest.write.mode("overwrite")
    (out.partitionBy(*keys) if keys else out).json(path)
