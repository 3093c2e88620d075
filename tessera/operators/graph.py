"""Graph operators on triples and edge tables: paths, closures, construct and update as DataFrame algebra."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_folder(sc: SparkContext) -> str:
    """The session's checkpoint folder: the one of ``spark.checkpoint.dir``, and a temporary one only where that is unset
    and the master is local; a cluster must name one that its executors share."""
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Run once and keep the rows in the shared folder."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Run once into a Parquet table in the shared folder: later steps read the columns that they need, and none of
    their filters or joins evaluates ``df`` again."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark.sparkContext), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a broadcast side may have at most.
FEW = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for a broadcast if its counted ``rows`` are few."""
    return F.broadcast(df) if rows <= FEW else df


def join_by(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of one name in which null keys meet null keys; the columns of ``on`` come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"_by_{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in on]
    return left.join(renamed, condition, how).drop(*[f"_by_{c}" for c in on])


def graph_merge(triples: DataFrame, *graphs: str) -> DataFrame:
    """The default graph made of several named ones: a set of (s, p, o)."""
    return triples.filter(F.col("g").isin(*graphs)).drop("g").distinct()


def pattern(triples: DataFrame, predicate: str, subject: str, value: str) -> DataFrame:
    """?subject <predicate> ?value."""
    return triples.filter(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o_value").alias(value))


def path(first: DataFrame, second: DataFrame, via_first: str, via_second: str) -> DataFrame:
    """Sequence path: the middle node is joined and dropped; repeated ways count (a bag)."""
    joined = first.join(second, first[via_first] == second[via_second])
    return joined.drop(first[via_first], second[via_second])


def closure(edges: DataFrame, source: str = "src", target: str = "dst", reflexive: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """All pairs joined by one or more edges, with ``reflexive`` each node with itself too; cycles end.

    Pairs are known with their distance. Once all up to n are known, those of exactly n that go on are joined with all known
    ones, which gives every pair of n + 1 to 2n: once only where no node has two parents and none is on a cycle (a forest),
    so only other graphs are made distinct. A cycle of a graph with single parents shows as a node that reaches itself.
    """
    links = edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).distinct()
    sources = edges.select(F.col(source).alias("_s")).distinct()
    flagged = links.join(sources, F.col("dst") == F.col("_s"), "left").select("src", "dst", F.lit(1).cast("long").alias("d"), F.col("_s").isNotNull().alias("more"))
    known = first = stored(flagged)  # more: whether an edge goes on from dst
    looped = lambda df: not df.filter(F.col("src").eqNullSafe(F.col("dst"))).isEmpty()
    forest = not looped(first) and first.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    n = 1
    while True:
        ends = known.filter((F.col("d") == n) & F.col("more")).select("src", F.col("dst").alias("_m"))
        if ends.isEmpty():
            break
        on = known.select(F.col("src").alias("_m"), "dst", "d", "more")
        fresh = ends.join(on, "_m").select("src", "dst", (F.col("d") + n).alias("d"), "more")
        if forest and ends.join(on.filter((F.col("d") == n) & F.col("more")), "_m").isEmpty():
            known = known.unionByName(fresh)  # the last round of a forest: nothing to compare, so nothing to keep
            break
        if forest:
            fresh = stored(fresh)
            forest = not looped(fresh)
        if not forest:
            fresh = stored(fresh.groupBy("src", "dst").agg(F.min("d").alias("d"), F.max("more").alias("more")).join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        known = known.unionByName(fresh)  # tables that are kept, one for each doubling
        n *= 2
    pairs = known.select("src", "dst")
    if reflexive:
        all_nodes = nodes.select(F.col(nodes.columns[0]).alias("n")) if nodes is not None else first.select(F.col("src").alias("n")).distinct().unionByName(first.select(F.col("dst").alias("n")))
        alone = all_nodes.distinct()
        if not forest:
            on_cycles = pairs.filter(F.col("src").eqNullSafe(F.col("dst"))).select("src")
            alone = alone.join(on_cycles, F.col("n").eqNullSafe(F.col("src")), "left_anti")
        pairs = pairs.unionByName(alone.select(F.col("n").alias("src"), F.col("n").alias("dst")))
    return pairs.select(F.col("src").alias(source), F.col("dst").alias(target))


def reachable(edges: DataFrame, roots: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Nodes that some root reaches, roots included; the frontier alone is joined in each round."""
    seen = cut(roots.select(F.col(roots.columns[0]).alias("node")).distinct())
    front = seen
    while not front.isEmpty():
        after = front.join(edges, front["node"] == edges[source]).select(F.col(target).alias("node")).distinct()
        front = cut(after.join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def transitive_reduction(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges of an acyclic graph without those that a longer way replaces.

    An edge is replaced if its end has another parent that is reached from its start. Only such parents (of
    nodes with several) are followed upwards, a step a round, and no pair of nodes is kept but these parents with
    what lies above them.
    """
    direct = cut(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).distinct())
    forked = direct.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").select("dst")
    ends = cut(direct.join(forked, "dst", "left_semi"))
    seen = cut(ends.select(F.col("src").alias("low"), F.col("src").alias("high")).distinct())
    front = seen
    while not front.isEmpty():
        above = front.join(direct.withColumnsRenamed({"src": "_up", "dst": "high"}), "high").select("low", F.col("_up").alias("high")).distinct()
        front = cut(above.join(seen, ["low", "high"], "left_anti"))
        seen = seen.unionByName(front)
    longer = ends.select(F.col("src").alias("low"), "dst").join(seen.filter("low <> high"), "low").select(F.col("high").alias("src"), "dst").distinct()
    return direct.join(longer, ["src", "dst"], "left_anti").select(F.col("src").alias(source), F.col("dst").alias(target))


def construct(rows: DataFrame, *templates: tuple[Column, str, Column]) -> DataFrame:
    """Triples (s, p, o) of each row and template; those with an unbound part fall away; a set."""
    out = None
    for subject, predicate, value in templates:
        part = rows.select(subject.cast("string").alias("s"), F.lit(predicate).alias("p"), value.cast("string").alias("o")).filter("s is not null and o is not null")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def insert_where(graph: DataFrame, rows: DataFrame) -> DataFrame:
    """The graph with the rows added, as a set."""
    return graph.unionByName(rows.select(*graph.columns)).distinct()


def delete_where(graph: DataFrame, rows: DataFrame) -> DataFrame:
    """The graph without the rows."""
    return graph.join(rows.select(*graph.columns), graph.columns, "left_anti")


def remove_subtree(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """Triples but for those whose subject is reached from a root over any predicate."""
    gone = reachable(triples.select(F.col("s").alias("src"), F.col("o").alias("dst")), roots)
    return triples.join(gone.select(F.col("node").alias("s")), "s", "left_anti").select(*triples.columns)
