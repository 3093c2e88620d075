"""One run of the miner over the datasets of a catalog, which can be stopped and begun again.

Datasets are taken in waves, in the order of their IRIs; a wave is one set of jobs with the dataset as a
grouping key. A wave writes its tables into folders of its own attempt and then appends one file with a row for each of
its datasets to the table of commits. That file appears as a whole or not at all, and readers look only at what it
names: what a stopped wave has left counts nowhere. The same run, started again, goes on after the last wave
that was committed. One run at a time writes to a folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import templates
from tessera.operators.graph import join_by, stored
from tessera.operators.nested import nested_forest
from tessera.plans.mining import MiningOptions, forest_triples, mine_templates, single_query_triples, stats_table
from tessera.sources.rdf import prefixes_of_json
from tessera.sources.sinks import recorded_run

COMMITS = "seq long, run string, dataset string, attempt string, options string, at timestamp"


@dataclass(frozen=True)
class RunOptions:
    """``wave``: datasets that are mined and committed together. ``by_cluster``: the queries have a column cluster (an IRI), and
    templates are mined within each cluster of a dataset."""

    mining: MiningOptions = field(default_factory=lambda: MiningOptions(generalization_tree=True))
    start_from_dataset: str | None = None
    exclude_datasets: tuple[str, ...] = ()
    by_cluster: bool = False
    base: str = "http://example.org/"
    default_preamble: str = ""
    show_binding_distributions: bool = False
    only_roots: bool = False
    as_array: bool = True
    wave: int = 200

    @property
    def keys(self) -> tuple[str, ...]:
        return ("dataset", "cluster") if self.by_cluster else ("dataset",)

    @property
    def results(self) -> str:
        """All that the rows depend on: how many datasets a wave takes is not among it."""
        return repr({k: v for k, v in vars(self).items() if k != "wave"})


def dataset_preambles(catalog: DataFrame) -> DataFrame:
    """dataset, preamble: the endpoint as base and the prefixes of the catalog's JSON objects; what is not JSON declares none."""
    declared = F.transform(F.map_entries(prefixes_of_json("prefixesJson")), lambda e: F.concat(F.lit("PREFIX "), e["key"], F.lit(": <"), e["value"], F.lit(">")))
    base = F.when(F.col("endpoint") != "", F.concat(F.lit("BASE <"), "endpoint", F.lit(">")))
    lines = catalog.select("dataset", F.concat_ws("\n", base, F.array_join(declared, "\n")).alias("preamble"))
    return lines.groupBy("dataset").agg(F.min("preamble").alias("preamble"))


def _commit(spark: SparkSession, out: str, rows: list[tuple]) -> None:
    """One file with all rows, so they are committed together."""
    named = spark.createDataFrame(rows, "seq long, run string, dataset string, attempt string, options string")
    named.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{out}/_commits")


def commits(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(COMMITS).parquet(f"{out}/_commits")


def _live(spark: SparkSession, out: str) -> DataFrame:
    """dataset, attempt: the last commit of each dataset, unless it removed the dataset."""
    return commits(spark, out).groupBy("dataset").agg(F.max_by("attempt", "seq").alias("attempt")).filter("attempt is not null")


def committed(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """The rows of a table that have been committed, None if no live attempt has it. One folder a wave is read."""
    live = _live(spark, out)
    folders = [f"{out}/{table}/{r.attempt}" for r in live.select("attempt").distinct().collect()]
    there = [f for f in folders if _exists(spark, f)]
    return join_by(spark.read.parquet(*there), live, ["dataset", "attempt"], "left_semi").drop("attempt") if there else None


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _next_seq(spark: SparkSession, out: str) -> int:
    return (commits(spark, out).agg(F.max("seq")).first()[0] or 0) + 1


def remove_datasets(spark: SparkSession, out: str, *datasets: str) -> None:
    """The datasets' results count no more; a run that has committed them does not mine them again."""
    seq = _next_seq(spark, out)
    _commit(spark, out, [(seq, None, d, None, None) for d in datasets])


def _tables(usage: DataFrame, preambles: DataFrame, action_iri: str, options: RunOptions) -> dict[str, DataFrame]:
    keys = options.keys
    mined = mine_templates(usage, options.mining, keys)
    mined = replace(mined, templates=stored(mined.templates), instances=stored(mined.instances))
    if options.by_cluster:
        preambles = usage.select(*keys).distinct().join(preambles, "dataset")
    dataset_iri, cluster_iri = F.col("dataset"), F.col("cluster") if options.by_cluster else None
    statements = forest_triples(mined, dataset_iri, options.base, cluster_iri, preambles, options.default_preamble, with_keys=True)
    if mined.simple is not None:
        statements = statements.unionByName(single_query_triples(mined, action_iri, dataset_iri, cluster_iri, with_keys=True))
    out = {"templates": mined.templates, "statements": statements, "stats": stats_table(mined, by_key=True)}
    if mined.forest is not None:
        out["nested"] = nested_forest(mined.nodes, mined.edges, keys, options.as_array, options.only_roots)
    if mined.simple is not None:
        out["single_queries"] = mined.simple
    if options.show_binding_distributions:
        out["binding_distributions"] = templates.binding_counts(mined.instances, keys)
    return out


def run_datasets(usage: DataFrame, catalog: DataFrame, out: str, run: str, options: RunOptions = RunOptions()) -> int:
    """Mines the queries (dataset, id, text, num_exec, t_first, t_last, with ``by_cluster`` cluster) of the catalog's datasets
    (dataset, endpoint, prefixesJson) into the folder ``out``; the number of datasets that this call has committed.

    ``run`` names the run: what it has committed before is left alone, and options other than its own are an error. A run
    of another name mines everything anew and replaces a dataset's rows with its commit. Datasets without queries are
    committed with no rows; a null dataset and queries outside the catalog are not mined. Each wave is logged in
    ``out/_runs`` as started and then as completed or failed; an error is raised again.
    """
    spark = usage.sparkSession
    _commit(spark, out, [])  # the table of commits is there from the first run on
    own = commits(spark, out).filter(F.col("run") == run)
    if not own.filter(F.col("options") != options.results).isEmpty():
        raise ValueError(f"run {run} has been begun with other options")
    wanted = catalog.filter("dataset is not null").filter(~F.col("dataset").isin(*options.exclude_datasets)) if options.exclude_datasets else catalog.filter("dataset is not null")
    if options.start_from_dataset is not None:
        wanted = wanted.filter(F.col("dataset") >= options.start_from_dataset)
    preambles, finished = dataset_preambles(catalog), 0
    while True:
        own = commits(spark, out).filter(F.col("run") == run).select("dataset")
        names = [r.dataset for r in wanted.select("dataset").distinct().join(own, "dataset", "left_anti").orderBy("dataset").limit(options.wave).collect()]
        if not names:
            return finished
        attempt = uuid.uuid4().hex
        with recorded_run(spark, f"{out}/_runs", names, options.results) as action:
            rows = _tables(usage.filter(F.col("dataset").isin(*names)), preambles.filter(F.col("dataset").isin(*names)), f"{options.base}actions/{action}", options)
            for name, table in rows.items():
                table.withColumn("attempt", F.lit(attempt)).write.parquet(f"{out}/{name}/{attempt}")
            seq = _next_seq(spark, out)
            _commit(spark, out, [(seq, run, d, attempt, options.results) for d in names])
        finished += len(names)
