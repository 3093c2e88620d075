"""From statements in file order to queries and executions.

Order matters here, so rows carry ``line``, their place in the file: sets of execution properties end
at their time, and the k-th set of an execution IRI belongs to the k-th query that names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import LSQV, PROV
from tessera.operators.graph import stored
from tessera.operators.stats import numbered

REMOTE_EXEC = "http://lsq.aksw.org/re-"
QUERY_PREFIX = "http://lsq.aksw.org/lsqQuery-"
_PROPERTIES = {PROV + "atTime": "atTime", LSQV + "hostHash": "hostHash"}


def pair_in_order(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The k-th row of ``left`` with the k-th of ``right`` for each key, by ``order``; unmatched rows fall away."""
    ranked = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked(left).drop(order).join(ranked(right).drop(order), [key, "_k"]).drop("_k")


def route(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others (those for which it is null among them)."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(hit), df.filter(~hit)


_STRETCH = 100_000


def _joined(rows: DataFrame, sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with the sums of their stretch; null keys are keys as any other."""
    named = sums.select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], *[c for c in sums.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]
    return rows.join(named, same).drop(*[f"_of_{i}" for i in range(len(keys))])


def run_groups(rows: DataFrame, group: str, order: str, partition: str | None = None) -> DataFrame:
    """``run``: number of the contiguous run of equal ``group`` values; a group that comes back begins a new run.

    Runs are counted within ``partition`` (a file, a source) if one is named. ``order`` is a whole number: it
    is cut into stretches, so that no file is ordered in one task, and an offset joins the runs of its stretches.
    """
    parts = (partition,) if partition else ()
    keys = (*parts, "_stretch")
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_stretch", F.floor(F.col(order) / _STRETCH))
    marked = marked.withColumn("_start", ((~F.col(group).eqNullSafe(F.lag(group).over(w))) & (F.row_number().over(w) > 1)).cast("int"))
    # one row for each stretch
    ends = marked.groupBy(*keys).agg(F.sum("_start").alias("_n"), F.min_by(group, order).alias("_first"), F.max_by(group, order).alias("_last"))
    by_stretch = Window.partitionBy(*parts).orderBy("_stretch")
    fresh = (~F.col("_first").eqNullSafe(F.lag("_last").over(by_stretch)) | (F.row_number().over(by_stretch) == 1)).cast("int")
    ends = ends.withColumn("_fresh", fresh)
    before = F.coalesce(F.sum(F.col("_n") + F.col("_fresh")).over(by_stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = _joined(marked, ends.select(*keys, (before + F.col("_fresh")).alias("_offset")), keys)
    return numbered.withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_offset")).drop("_stretch", "_start", "_offset")


def execution_sets(triples: DataFrame, file: str = "file") -> DataFrame:
    """file, exec_iri, line (of its end), ts, host of each execution set.

    A set takes the properties of execution subjects in file order up to its ``atTime``; the first
    subject names it. A host before the time belongs to it, one after the time to the next set; of
    several hosts each makes an execution of its own with the same time (the last takes the time
    last, but every one lacks it until then).
    """
    own = triples.filter(F.col("s").startswith(REMOTE_EXEC)).withColumn("property", F.element_at(F.create_map(*[F.lit(x) for kv in _PROPERTIES.items() for x in kv]), F.col("p")))
    # sets closed before a line: those before it in its stretch, and those of earlier stretches of the file
    keys, end = (file, "_stretch"), F.coalesce((F.col("property") == "atTime").cast("int"), F.lit(0))
    own = own.withColumn("_stretch", F.floor(F.col("line") / _STRETCH))
    earlier = Window.partitionBy(file).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy(*keys).agg(F.sum(end).alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    numbered = _joined(own, ends, keys).withColumn("_set", F.coalesce(F.sum(end).over(w), F.lit(0)) + F.col("_offset"))
    sets = numbered.groupBy(file, "_set").agg(
        F.min_by("s", "line").alias("exec_iri"),
        F.max(F.when(F.col("property") == "atTime", F.col("line"))).alias("line"),
        F.max(F.when(F.col("property") == "atTime", F.col("o_value"))).alias("ts"),
        F.collect_list(F.when(F.col("property") == "hostHash", F.col("o_value"))).alias("_hosts"),
    )
    return sets.filter("ts is not null").select(file, "exec_iri", "line", "ts", F.explode_outer("_hosts").alias("host"))


def assemble(triples: DataFrame, dataset: str, file: str = "file", by_dataset: bool = False) -> tuple[DataFrame, DataFrame]:
    """queries (dataset, query_iri, id, text) and execs (dataset, exec_iri, query_iri, ts, host).

    A query's text counts once, and only if an execution names the query. Executions get new IRIs,
    numbered within their query (as the stream does, which has no order over all files) or, with ``by_dataset``, from 1 on
    through the whole dataset: by file, and within it in the order in which an execution and its query have both been read.
    """
    # lines are parsed once: what follows reads only these of them, by their kind
    asked = F.col("p").isin(LSQV + "hasRemoteExec", LSQV + "text") | F.col("s").startswith(REMOTE_EXEC)
    triples = stored(triples.filter(asked).select(file, "line", "s", "p", "o_value"))
    names = triples.filter(F.col("p") == LSQV + "hasRemoteExec").select(file, "line", F.col("s").alias("query_iri"), F.col("o_value").alias("exec_iri"))
    texts = triples.filter(F.col("p") == LSQV + "text").select("line", F.col("s").alias("query_iri"), F.col("o_value").alias("text"))
    first = texts.groupBy("query_iri").agg(F.min_by("text", "line").alias("text"))
    queries = first.join(names.select("query_iri").distinct(), "query_iri", "left_semi").select(
        F.lit(dataset).alias("dataset"), "query_iri", F.expr(f"substr(query_iri, {len(QUERY_PREFIX) + 1})").alias("id"), "text"
    )
    sets = execution_sets(triples, file).groupBy(file, "exec_iri", "line", "ts").agg(F.collect_list("host").alias("_hosts"))
    paired = _paired(names, sets, file)
    order = ["_file", "_line"] if by_dataset else []
    if by_dataset:
        paired = paired.withColumns({"_file": F.col(file), "_line": F.greatest("_named", "_ended")})
    rows = paired.select("query_iri", F.col("exec_iri").alias("_old"), "ts", F.explode_outer("_hosts").alias("host"), *order)
    if by_dataset:
        named = numbered(rows, [F.col("_file"), F.col("_line"), F.col("host"), F.col("query_iri")]).withColumn("_n", F.col("query_id").cast("string"))
    else:
        number = F.row_number().over(Window.partitionBy("query_iri").orderBy("_old", "ts", "host"))
        named = rows.withColumn("_n", F.concat(F.md5(F.col("query_iri")), F.lit("-"), number.cast("string")))
    execs = named.select(F.lit(dataset).alias("dataset"), F.concat(F.lit(f"{dataset}/executions/"), "_n").alias("exec_iri"), "query_iri", "ts", "host")
    return queries, execs


def _paired(names: DataFrame, sets: DataFrame, file: str) -> DataFrame:
    """The k-th name of an execution IRI in a file with its k-th set; ``_named`` and ``_ended`` are their lines."""
    ranked = lambda df, line: df.withColumn("_k", F.row_number().over(Window.partitionBy(file, "exec_iri").orderBy("line"))).withColumnRenamed("line", line)
    return ranked(names, "_named").join(ranked(sets, "_ended"), [file, "exec_iri", "_k"]).drop("_k")


def first_text_per_id(rows: DataFrame, order: str) -> DataFrame:
    """One row an id, the first by ``order``."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), order).alias("_r")).select("id", "_r.*")
