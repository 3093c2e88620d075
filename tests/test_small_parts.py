"""Sinks, readers and scalars that no registered query goes through."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import graph, ingest
from tessera.sources import rdf, sinks


def test_csv_without_a_header_and_split_by_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1,ASK { 1 }\n2,\"ASK { \"\"a,b\"\" }\"\n")
    for multi_line in (True, False):
        rows = rdf.read_csv(spark, str(tmp_path / "c.csv"), rdf.CLUSTERS_CSV, header=False, multi_line=multi_line).collect()
        assert {tuple(r) for r in rows} == {(1, "ASK { 1 }"), (2, 'ASK { "a,b" }')}
    named = rdf.read_directory(spark, str(tmp_path), rdf.CLUSTERS_CSV, ".csv", header=False, multi_line=False)
    assert {r.name for r in named.collect()} == {"c"} and named.count() == 2


def test_tables_keep_the_partitions_that_are_not_written(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "dataset string, n int")
    path = str(tmp_path / "t")
    sinks.write_tables(rows(("a", 1), ("a", 2), ("b", 3)), path, "dataset")
    sinks.write_tables(rows(("b", 4), ("c", 5)), path, "dataset")
    assert {(r.dataset, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("a", 2), ("b", 4), ("c", 5)}


def test_csv_and_json_round_trips(spark, tmp_path):
    rows = [("a", 'x "y", z\nnext', 1), ("b", None, 2), ("b", "é🙂\\", 3)]
    df = spark.createDataFrame(rows, "k string, text string, n int")
    sinks.write_csv(df, str(tmp_path / "csv"))
    again = rdf.read_csv(spark, str(tmp_path / "csv"), "k string, text string, n int").collect()
    assert {tuple(r) for r in again} == set(rows)
    sinks.write_json(df.withColumn("children", F.array(F.struct("n", "text"))), str(tmp_path / "json"), "k")
    found = [json.loads(line) for f in (tmp_path / "json").glob("k=b/*.json") for line in f.read_text(encoding="utf-8").splitlines()]
    assert sorted((x["n"], x.get("text"), x["children"][0].get("text")) for x in found) == [(2, None, None), (3, "é🙂\\", "é🙂\\")]


def test_first_text_of_an_id_and_pattern(spark):
    rows = spark.createDataFrame([("q", "late", 9), ("q", "early", 1), ("r", None, 5)], "id string, text string, line int")
    assert {(r.id, r.text, r.line) for r in ingest.first_text_per_id(rows, "line").collect()} == {("q", "early", 1), ("r", None, 5)}
    triples = spark.createDataFrame([("s", "p", "o"), ("s", "q", "x"), ("t", "p", None)], "s string, p string, o_value string")
    assert {tuple(r) for r in graph.pattern(triples, "p", "subject", "value").collect()} == {("s", "o"), ("t", None)}


def test_names_for_iris(spark):
    df = spark.createDataFrame([("a b-c/é#",), (None,)], "t string")
    got = df.select(C.escape_iri_fragment(F.col("t")).alias("e"), C.safe_id(F.col("t")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("a%20b-c%2F%C3%A9%23", "a b_c/é#"), (None, None)]
