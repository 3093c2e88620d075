from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.plans.mining import MiningOptions
from tessera.plans.runs import RunOptions, commits, committed, remove_datasets, run_datasets
from tessera.sources.sinks import run_states

OPTIONS = RunOptions(MiningOptions(min_instances=2, include_simple_queries=True), wave=1, show_binding_distributions=True, default_preamble="PREFIX z: <http://z#>")


def _log(spark):
    rows = [(f"http://lsq.aksw.org/datasets/{d}", f"{d}{i}", f"ASK {{ z:k <r/{i}> . ?a a:p {i % 2} }}" if i < 3 else f"DESCRIBE <http://only/{d}>") for d in "abc" for i in range(4)]
    rows.append(("http://elsewhere", "x", "ASK { 1 2 3 }"))
    usage = spark.createDataFrame(rows, "dataset string, id string, text string")
    return usage.withColumns({"num_exec": F.lit(2).cast("long"), "t_first": F.lit(None).cast("timestamp_ntz"), "t_last": F.lit(None).cast("timestamp_ntz")})


def _catalog(spark):
    name = "http://lsq.aksw.org/datasets/"
    rows = [(name + "c", "c", None, "no json"), (name + "a", "a", "http://end/a/", '{"a": "http://a#"}'), (name + "b", "b", "", None), (name + "empty", "empty", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "dataset string, datasetId string, endpoint string, prefixesJson string")


def _rows(spark, out, table):
    df = committed(spark, out, table)
    # the actions of runs have names of their own
    return sorted(map(repr, df.filter("s not like '%actions/%'").collect() if table == "statements" else df.collect()))


def test_a_run_that_is_stopped_goes_on_where_it_was(spark, tmp_path):
    usage, catalog, whole, stopped = _log(spark), _catalog(spark), str(tmp_path / "whole"), str(tmp_path / "stopped")
    assert run_datasets(usage, catalog, whole, "r", OPTIONS) == 4
    assert run_datasets(usage, catalog, whole, "r", OPTIONS) == 0
    broken = usage.withColumn("text", F.when(F.col("dataset").endswith("/b"), F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        run_datasets(broken, catalog, stopped, "r", OPTIONS)
    assert [r.dataset[-1] for r in commits(spark, stopped).collect()] == ["a"]
    assert {r.dataset[-1] for r in committed(spark, stopped, "templates").collect()} == {"a"}
    states = {(r.dataset[-1], r.status) for r in run_states(spark, f"{stopped}/_runs").collect()}
    assert states == {("a", "Completed"), ("b", "Failed")}
    # the size of a wave may change, what the rows depend on may not
    with pytest.raises(ValueError, match="other options"):
        run_datasets(usage, catalog, stopped, "r", RunOptions(OPTIONS.mining))
    assert run_datasets(usage, catalog, stopped, "r", RunOptions(**{**vars(OPTIONS), "wave": 10})) == 3
    for table in ("templates", "statements", "stats", "single_queries", "binding_distributions"):
        assert _rows(spark, stopped, table) == _rows(spark, whole, table) != []
    terms = {(r.dataset[-1], r.o_value) for r in committed(spark, whole, "statements").filter("o_kind = 'term'").collect()}
    assert {t for t in terms if t[0] == "a"} == {("a", f"<http://end/a/r/{i}>") for i in range(3)} | {("a", "0"), ("a", "1")}
    assert {t for t in terms if t[0] == "c"} == {("c", "0"), ("c", "1")}
    stats = [(r.dataset[-1], r.query_id, r.num_instances, r.num_specializations) for r in committed(spark, whole, "stats").orderBy("dataset", "query_id").collect()]
    assert stats == [(d, k, 3, 1 - k) for d in "abc" for k in (0, 1)]
    parts = committed(spark, whole, "statements").filter("p like '%isPartOf'").collect()
    assert {(r.dataset, r.o_value) for r in parts} == {(r.dataset, r.dataset) for r in parts} and len(parts) == 3
    remove_datasets(spark, whole, "http://lsq.aksw.org/datasets/a")
    assert {r.dataset[-1] for r in committed(spark, whole, "templates").collect()} == {"b", "c"}


def test_first_dataset_excluded_ones_and_clusters(spark, tmp_path):
    name, out = "http://lsq.aksw.org/datasets/", str(tmp_path / "out")
    usage = _log(spark).withColumn("cluster", F.concat(F.lit("http://cluster/"), F.substring("id", 2, 1).cast("int") % 2))
    options = RunOptions(MiningOptions(generalization_tree=True), start_from_dataset=name + "b", exclude_datasets=(name + "c",), by_cluster=True, only_roots=True)
    assert run_datasets(usage, _catalog(spark), out, "r", options) == 2
    got = sorted((r.dataset[-1], r.cluster[-1], r.body[:3], r.num_instances) for r in committed(spark, out, "templates").collect())
    # the queries 0 and 2 of cluster 0 are of one kind, 1 and 3 of cluster 1 of two
    assert got == [("b", "0", "ASK", 2), ("b", "1", "ASK", 1), ("b", "1", "DES", 1)]
    up = committed(spark, out, "statements").filter("p like '%specializationOf' and o_value like 'http://cluster/%'").collect()
    assert {(r.cluster, r.o_value) for r in up} == {(f"http://cluster/{k}", f"http://cluster/{k}") for k in (0, 1)}
    assert committed(spark, out, "nested").count() == 3
