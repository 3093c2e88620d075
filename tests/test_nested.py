from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.graph import stored
from tessera.operators.nested import nested_forest, write_nested
from tessera.operators.specialize import specialization_forest
from tessera.operators.templates import generalize

COLUMNS = "dataset string, id string, text string, num_exec long"


@pytest.fixture(scope="module")
def forest(spark):
    r = random.Random(3)
    rows = [(r.choice([None, "d"]), f"q{i}", f"ASK {{ <http://a/{r.randrange(2)}> ex:p {r.randrange(3)} , {r.randrange(2)} }}", i) for i in range(16)]
    nodes, edges = specialization_forest(generalize(spark.createDataFrame(rows, COLUMNS), keys=("dataset",)), 2, 1, keys=("dataset",))
    return stored(nodes), stored(edges)


def _plain(nodes, edges):
    """(dataset, text) of each root with its tree of dicts."""
    of = {(n.dataset, n.node): n for n in nodes.collect()}
    below: dict = {}
    for e in edges.collect():
        below.setdefault((e.dataset, e.parent), []).append(e.node)
    ends = {(d, c) for (d, _), cs in below.items() for c in cs}

    def tree(d, text):
        n = of[d, text]
        return {"node": text, "num_instances": n.num_instances, "num_exec": n.num_exec, "n_params": n.n_params, "specializations": [tree(d, c) for c in sorted(below.get((d, text), []))]}

    return {k: tree(*k) for k in of if k not in ends}, of, below


def test_nested_values_like_plain_trees(forest):
    nodes, edges = forest
    want, _, _ = _plain(nodes, edges)
    rows = nested_forest(nodes, edges, ("dataset",)).select("*", F.to_json("value").alias("j")).collect()
    assert {(r.dataset, r.node): json.loads(r.j) for r in rows} == want
    assert any(c["specializations"] for t in want.values() for c in t["specializations"])
    size = lambda t: 1 + sum(size(c) for c in t["specializations"])
    assert all(r.n_nodes == size(want[r.dataset, r.node]) and r.nested and r.under is None for r in rows)


def test_objects_by_text_and_roots_alone(forest):
    nodes, edges = forest
    want, _, _ = _plain(nodes, edges)
    rows = nested_forest(nodes, edges, ("dataset",), as_array=False).select("dataset", "node", F.to_json("value").alias("j")).collect()
    by_text = lambda t: t | {"specializations": {c["node"]: by_text(c) for c in t["specializations"]}}
    assert {(r.dataset, r.node): json.loads(r.j) for r in rows} == {k: by_text(t) for k, t in want.items()}
    roots = nested_forest(nodes, edges, ("dataset",), only_roots=True).select("dataset", "node", F.to_json("value").alias("j")).collect()
    assert {(r.dataset, r.node): json.loads(r.j) for r in roots} == {k: {f: v for f, v in t.items() if f != "specializations"} for k, t in want.items()}


def test_large_trees_are_cut_and_lose_nothing(forest):
    nodes, edges = forest
    _, of, below = _plain(nodes, edges)
    rows = nested_forest(nodes, edges, ("dataset",), most_nodes=3).select("*", F.to_json("value").alias("j")).collect()
    size = lambda t: 1 + sum(size(c) for c in t["specializations"])
    links, seen = set(), set()

    def walk(d, t):
        seen.add((d, t["node"]))
        for c in t["specializations"]:
            links.add((d, t["node"], c["node"]))
            walk(d, c)

    for r in rows:
        tree = json.loads(r.j)
        assert size(tree) <= 3
        assert r.nested or not tree["specializations"]
        walk(r.dataset, tree)
        if r.under is not None:
            links.add((r.dataset, r.under, r.node))
    assert seen == set(of) and links == {(d, p, c) for (d, p), cs in below.items() for c in cs}
    assert any(not r.nested for r in rows)


def test_files_by_dataset_and_an_empty_forest(forest, tmp_path):
    nodes, edges = forest
    write_nested(nested_forest(nodes, edges, ("dataset",)), str(tmp_path / "out"), "dataset")
    back = [json.loads(line) for f in (tmp_path / "out").rglob("*.json") for line in f.read_text().splitlines()]
    assert sorted(b["node"] for b in back) == sorted(t["node"] for t in _plain(nodes, edges)[0].values())
    assert (tmp_path / "out" / "dataset=d").is_dir()
    assert nested_forest(nodes.limit(0), edges.limit(0), ("dataset",)).count() == 0
