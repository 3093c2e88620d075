from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lattice, templates
from tessera.operators.specialize import specialization_forest
from tessera.plans.mining import MiningOptions, forest_triples, generalize_and_aggregate, mine_by_cluster, mine_templates, stats_table

COLUMNS = "id string, text string, num_exec long, t_first int, t_last int"


def _usage(spark, texts):
    return spark.createDataFrame([(f"q{i}", t, n, i, i) for i, (t, n) in enumerate(texts)], COLUMNS)


def _plain_simplify(bindings):
    """Constant or lowest equal position for each position of one template."""
    out = []
    for p in range(len(bindings[0])):
        column = [b[p] for b in bindings]
        if len(set(column)) == 1:
            out.append(column[0])
        else:
            out.append(next(k for k in range(p + 1) if [b[k] for b in bindings] == column and len({b[k] for b in bindings}) > 1))
    return out


def test_simplify_golden(spark):
    rows = [("SELECT ex:x { 1 a:b 1 ; c:k }", 1), ("SELECT ex:y { 2 a:b 2 ; c:k }", 1)]
    done = templates.simplify(templates.generalize(_usage(spark, rows)))
    assert {r.text for r in done.collect()} == {"SELECT $__PARAM_0 { $__PARAM_1 a:b $__PARAM_1 ; c:k }"}
    assert sorted(tuple(r.bindings) for r in done.collect()) == [("ex:x", "1"), ("ex:y", "2")]


def test_three_instances_of_the_golden_class(spark):
    rows = [("SELECT rdf:type { 5000 5000 }", 2), ("SELECT rdfs:label { 10000 10000 }", 7), ("SELECT rdf:type { 120000 5000 }", 1)]
    inst = templates.generalize(_usage(spark, rows))
    stats = templates.roll_up(inst).first()
    assert stats.num_instances == 3 and stats.num_exec == 10 and math.isclose(stats.sum_log2_exec, 1 + math.log2(7))
    assert templates.simplify(inst).first().n_params == 3
    typed = templates.simplify(templates.select_by_value(inst, 0, "rdf:type"))
    assert {r.text for r in typed.collect()} == {"SELECT rdf:type { $__PARAM_0 5000 }"}
    paired = templates.simplify(templates.select_by_equal(inst, 1, 2))
    assert {r.n_params for r in paired.collect()} == {2}


def test_simplify_like_plain_version(spark):
    r = random.Random(5)
    rows = [(f"SELECT {r.choice('ab')}:x {{ {r.randrange(3)} {r.randrange(2)} {r.randrange(2)} }}", 1) for _ in range(40)]
    inst = templates.generalize(_usage(spark, rows)).cache()
    want = _plain_simplify([r.bindings for r in inst.orderBy("id").collect()])
    got = {r.pos: (r.constant if r.constant is not None else r.first) for r in templates.simplified_positions(inst).collect()}
    assert [got[p] for p in range(len(want))] == want


def test_thresholds_and_simple_queries(spark):
    usage = _usage(spark, [("ASK { a:b 1 }", 5), ("ASK { a:c 2 }", 1), ("DESCRIBE a:d", 3), ("SELECT 1 2 3", 1)])
    mined = mine_templates(usage, MiningOptions(min_instances=2, include_simple_queries=True, min_executions_for_simple_queries=2), ())
    assert [r.num_instances for r in mined.templates.collect()] == [2]
    assert [r.id for r in mined.simple.collect()] == ["q2"]
    assert "ASK { $__PARAM_0 $__PARAM_1 }" in mined.templates.first().text


def test_empty_log(spark):
    mined = mine_templates(_usage(spark, []), MiningOptions(generalization_tree=True), ())
    assert mined.templates.count() == 0 and mined.nodes.count() == 0 and mined.edges.count() == 0


def test_clusters_are_mined_apart(spark):
    rows = spark.createDataFrame([(1, "ASK { 1 }"), (2, "ASK { 1 }"), (2, "ASK { 2 }")], "groupId int, query string")
    out = {r.groupId: r.num_instances for r in mine_by_cluster(rows).templates.collect()}
    assert out == {1: 1, 2: 2}
    assert mine_by_cluster(rows, start_from=2).templates.count() == 1


def test_log_queries_leave_no_execution_out(spark, tmp_path):
    from tessera.plans import log_queries, mining_queries
    from tessera.sources.querylog import executions

    kinds = ["click", "view", "purchase", "signup", "error"]
    rows = [(i, i % 60, i % 11, kinds[i % 5], f'{{"k": {i % 4}}}') for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts int, user_id long, event_type string, props string").withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    texts = {}
    for r in executions(spark, str(tmp_path)).collect():
        texts[r.text] = texts.get(r.text, 0) + 1
    simple = log_queries.queries()["simple_queries_all"](spark, str(tmp_path)).collect()
    assert sorted(r.num_exec for r in simple) == sorted(texts.values())
    by_type = {}
    for t in texts:
        kind = 1 if "SELECT" in t else 2 if "CONSTRUCT" in t else 3 if "ASK" in t else 4
        by_type[kind] = by_type.get(kind, 0) + 1
    got = {}
    for r in mining_queries.mined_by_cluster(spark, str(tmp_path)).collect():
        got[r.groupId] = got.get(r.groupId, 0) + r.num_instances
    assert got == by_type


def test_preambles_last_definition_counts(spark):
    usage = _usage(spark, [("PREFIX a: <x1> ASK { a:b 1 }", 1), ("PREFIX a: <x2> PREFIX b: <y> ASK { a:c 1 }", 1)])
    row = templates.merged_preambles(templates.generalize(usage), "id").first()
    assert [(p.name, p.iri) for p in row.prefixes] == [("a", "x2"), ("b", "y")] and row.base is None


def _bell(n):
    row = [1]
    for _ in range(n):
        nxt = [row[-1]]
        for x in row:
            nxt.append(nxt[-1] + x)
        row = nxt
    return row[0]


def test_families():
    assert len(lattice.families([[0], [1, 3], [2]])) == 20
    assert len(lattice.families([[0], [1, 3], [2]], 1)) == 6
    for sizes in ((1,), (2, 2), (3, 1), (4,)):
        clusters, at = [], 0
        for s in sizes:
            clusters.append(list(range(at, at + s)))
            at += s
        assert len(lattice.families(clusters)) == math.prod(_bell(s + 1) for s in sizes)
    assert lattice.families([]) == [[]]


def test_generalizations_of_one_query(spark):
    found = lattice.generalizations(_usage(spark, [("ASK { a:b 1 1 }", 1)]), max_vars=3, include_identity=True).collect()
    assert len(found) == 2 * 5 and len({r.general for r in found}) == 10
    top = next(r for r in found if r.general == "ASK { $__PARAM_0 $__PARAM_1 $__PARAM_2 }")
    assert top.bindings == ["a:b", "1", "1"] and top.more_general == []
    one = next(r for r in found if r.general == "ASK { a:b $__PARAM_0 $__PARAM_0 }")
    assert set(one.more_general) == {"ASK { $__PARAM_0 $__PARAM_1 $__PARAM_1 }", "ASK { a:b $__PARAM_0 $__PARAM_1 }"}


def test_lattice_edges_and_roots(spark):
    usage = _usage(spark, [("ASK { a:b 1 }", 1), ("ASK { a:c 1 }", 1), ("ASK { a:b 2 }", 1)])
    kept, edges, roots = generalize_and_aggregate(usage, MiningOptions(max_vars=2))
    texts = {r.template for r in kept.collect()}
    assert texts == {"ASK { $__PARAM_0 $__PARAM_1 }", "ASK { $__PARAM_0 1 }", "ASK { a:b $__PARAM_0 }"}
    assert {(r.child, r.parent) for r in edges.collect()} == {("ASK { $__PARAM_0 1 }", "ASK { $__PARAM_0 $__PARAM_1 }"), ("ASK { a:b $__PARAM_0 }", "ASK { $__PARAM_0 $__PARAM_1 }")}
    assert [r.general for r in roots.collect()] == ["ASK { $__PARAM_0 $__PARAM_1 }"]


def _plain_lattice(texts, max_vars, least, executions=0):
    """All families of all queries, then the thresholds and the divergence: kept texts and edges between them."""
    from tessera.operators.tokenizer import decompose_text

    members, up = {}, set()
    for text, num in texts:
        pieces, constants, _ = decompose_text(text)
        shape = {}
        for i, c in enumerate(constants):
            shape.setdefault(c, []).append(i)
        groups = list(shape.values())
        found = [f for f in lattice.families(groups, max_vars) if f]
        vectors = {str(lattice.family_vector(f, len(constants))): f for f in found}

        def general(vector):
            return pieces[0] + "".join((c if v < 0 else f"$__PARAM_{v}") + p for c, v, p in zip(constants, vector, pieces[1:]))

        for f in found:
            t = general(lattice.family_vector(f, len(constants)))
            members.setdefault(t, []).append(([constants[b[0]] for b in f], num))
            up |= {(t, general(v)) for v in lattice.one_step_up(groups, f, set(vectors))}
    kept = {
        t: (len(rows), sum(n for _, n in rows))
        for t, rows in members.items()
        if len(rows) >= least and sum(n for _, n in rows) >= executions and all(max(list(x).count(v) for v in set(x)) < len(rows) for x in zip(*(b for b, _ in rows)))
    }
    return kept, {(a, b) for a, b in up if a in kept and b in kept}


@pytest.mark.parametrize("seed", [1, 3])
def test_lattice_like_all_families(spark, seed):
    r = random.Random(seed)
    shapes = ["ASK {{ {} {} }}", "ASK {{ {} {} {} . }}", "SELECT ?x {{ {} {} {} ; {} {} }}", "DESCRIBE {}"]
    texts = sorted({r.choice(shapes).format(*(r.choice(["a:b", "1", "2", '"x"', "<i>"][: 2 + seed]) for _ in range(5))) for _ in range(60)})
    usage = [(t, r.randrange(1, 9)) for t in texts]
    for max_vars, least, executions in ((2, 0, 0), (9, 3, 12)):
        kept, edges, roots = generalize_and_aggregate(_usage(spark, usage), MiningOptions(max_vars=max_vars, min_instances=least, min_executions=executions))
        want, steps = _plain_lattice(usage, max_vars, least, executions)
        assert {r.template: (r.num_instances, r.num_exec) for r in kept.collect()} == want
        assert {tuple(r) for r in edges.select("child", "parent").collect()} == steps
        assert {r.general for r in roots.collect()} == set(want) - {a for a, _ in steps}


def test_lattice_of_many_equal_constants_ends(spark):
    usage = _usage(spark, [("ASK { " + "1 " * 15 + "}", 3), ("ASK { " + "2 " * 15 + "}", 3)] + [("SELECT * { " + " ".join(f"a:c{i}" for i in range(30)) + f" {k} }}", 1) for k in range(9)])
    kept, edges, _ = generalize_and_aggregate(usage.filter("text not like 'ASK%'"), MiningOptions(max_vars=3))
    assert [r.num_instances for r in kept.collect()] == [9] and edges.count() == 0
    kept, _, _ = generalize_and_aggregate(usage.limit(1), MiningOptions(max_vars=3))
    assert kept.count() == 0


def test_null_keys_are_keys(spark):
    rows = [(None, "q0", "ASK { <http://a> 1 }"), (None, "q1", "ASK { <http://a> 2 }"), ("d", "q2", "ASK { <http://a> 1 }"), ("d", "q3", "ASK { <http://b> 3 }")]
    usage = spark.createDataFrame(rows, "dataset string, id string, text string").withColumns({"num_exec": F.lit(2).cast("long"), "t_first": F.lit(None).cast("timestamp_ntz"), "t_last": F.lit(None).cast("timestamp_ntz")})
    mined = mine_templates(usage, MiningOptions(generalization_tree=True))
    assert {(r.dataset, r.text.strip(), r.num_instances) for r in mined.templates.collect()} == {(None, "ASK { <http://a> $__PARAM_0 }", 2), ("d", "ASK { $__PARAM_0 $__PARAM_1 }", 2)}
    assert {(r.dataset, r.id, tuple(r.bindings)) for r in mined.instances.collect()} == {(None, "q0", ("1",)), (None, "q1", ("2",)), ("d", "q2", ("<http://a>", "1")), ("d", "q3", ("<http://b>", "3"))}
    assert {(r.dataset, r.node) for r in mined.nodes.filter("depth = 1").collect()} == {(None, "ASK { <http://a> 1 }"), (None, "ASK { <http://a> 2 }"), ("d", "ASK { <http://a> 1 }"), ("d", "ASK { <http://b> 3 }")}
    assert mined.edges.filter("dataset is null").count() == 2
    facts = forest_triples(mined, "http://ds")
    assert facts.filter("p like '%specializationOf'").count() == 4 and facts.filter("p like '%usedGuideline'").count() == 8
    assert stats_table(mined).filter("query_id > 0").agg(F.sum("num_specializations")).first()[0] == 4


def test_prologues_of_query_dataset_and_default(spark):
    rows = [
        ("d", "q0", "BASE <http://own/x/y> PREFIX a: <http://own/a#> ASK { a:b <../z> }"),
        ("d", "q1", "ASK { a:c <z> }"), ("e", "q2", "ASK { a:b <z> }"), ("e", "q3", "ASK { c:d <http://full> }"),
    ]
    usage = spark.createDataFrame(rows, "dataset string, id string, text string").withColumns({"num_exec": F.lit(1).cast("long"), "t_first": F.lit(None).cast("timestamp_ntz"), "t_last": F.lit(None).cast("timestamp_ntz")})
    shared = spark.createDataFrame([("d", "PREFIX a: <http://shared/a#> BASE <http://shared/>")], "dataset string, preamble string")
    facts = forest_triples(mine_templates(usage), "http://ds", preambles=shared, default_preamble="PREFIX a: <http://default/a#> PREFIX c: <http://default/c#>")
    terms = sorted(r.o_value for r in facts.filter("o_kind = 'term'").collect())
    # q2 has a prefix by default, but no base
    assert terms == ["<http://default/a#b>", "<http://default/c#d>", "<http://full>", "<http://own/a#b>", "<http://own/z>", "<http://shared/a#c>", "<http://shared/z>"]


def _plain_forest(bindings, pieces, least):
    """Closed sets of instances: text -> instances, by trying all values and pairs again and again."""

    def text(rows):
        slots, seen = [], []
        for s in _plain_simplify(rows):
            if isinstance(s, int):
                if s not in seen:
                    seen.append(s)
                slots.append(f"$__PARAM_{seen.index(s)}")
            else:
                slots.append(s)
        return pieces[0] + "".join(a + b for a, b in zip(slots, pieces[1:]))

    out, todo = {}, [list(range(len(bindings)))]
    while todo:
        ids = todo.pop()
        rows = [bindings[i] for i in ids]
        t = text(rows)
        if t in out:
            continue
        out[t] = ids
        n = len(rows[0])
        for p in range(n):
            for v in {r[p] for r in rows}:
                todo.append([i for i in ids if bindings[i][p] == v])
            for q in range(p + 1, n):
                todo.append([i for i in ids if bindings[i][p] == bindings[i][q]])
        todo = [x for x in todo if len(x) >= least]
    return out


def test_specializations_like_plain_version(spark):
    r = random.Random(8)
    rows = sorted({f"SELECT {r.choice('ab')}:x {{ {r.randrange(3)} {r.randrange(3)} }}" for _ in range(30)})
    inst = templates.generalize(_usage(spark, [(t, 1) for t in rows])).cache()
    plain = inst.orderBy("id").collect()
    want = _plain_forest([x.bindings for x in plain], plain[0].pieces, 2)
    nodes, edges = specialization_forest(inst, 2, 1, 4)
    got = {x.node: x.num_instances for x in nodes.collect()}
    assert got == {t: len(ids) for t, ids in want.items()}
    for e in edges.collect():
        assert set(want[e.node]) < set(want[e.parent])
        assert not any(set(want[e.node]) < set(v) < set(want[e.parent]) for v in want.values())


def test_specializations_have_no_level_limit(spark):
    from tessera.plans.mining import forest_triples

    # 2 * 2 * 2 * 2 * 2 values: five levels of fixed values, of which the last are single queries
    rows = [f"SELECT {a}:x {{ {b} {c} {d} {e} }}" for a in "ab" for b in (1, 2) for c in (3, 4) for d in (5, 6) for e in (7, 8)]
    usage = _usage(spark, [(t, 1) for t in rows])
    inst = templates.generalize(usage)
    plain = inst.orderBy("id").collect()
    want = _plain_forest([x.bindings for x in plain], plain[0].pieces, 1)
    nodes, _ = specialization_forest(inst, 1, 1)
    found = nodes.collect()
    assert {x.node: x.num_instances for x in found} == {t: len(ids) for t, ids in want.items()} and max(x.depth for x in found) == 5
    mined = mine_templates(usage, MiningOptions(generalization_tree=True), ())
    triples = forest_triples(mined, "http://d").collect()
    text = {t.s: t.o_value.strip() for t in triples if t.p.endswith("vocab#text") and "/templates/" in t.s}
    assert sorted(text.values()) == sorted(want)
    links = [(text[t.s], text[t.o_value]) for t in triples if t.p == "http://www.w3.org/ns/prov#specializationOf"]
    assert len(links) == mined.edges.count() and {a for a, _ in links} == {t for t in want if len(want[t]) < len(rows)}
    assert all(set(want[a]) < set(want[b]) for a, b in links)


def test_divergence(spark):
    inst = templates.generalize(_usage(spark, [("ASK { 1 2 }", 1), ("ASK { 1 3 }", 1), ("DESCRIBE ?x", 1)]))
    assert [r.template for r in templates.divergent(inst).collect()] == ["DESCRIBE ?x"]
    assert templates.divergent(inst.withColumn("bindings", F.slice("bindings", 2, 1))).count() == 2


def test_forests_are_told_apart_by_keys(spark):
    from tessera.plans.mining import forest_triples, stats_table

    rows = [("d1", "ASK { ex:a 1 }"), ("d1", "ASK { ex:a 2 }"), ("d2", "ASK { ex:b 3 }"), ("d2", "ASK { ex:b 4 }"), ("d3", "ASK { ex:b 4 }")]
    usage = spark.createDataFrame([(d, f"q{i}", t, i + 1, i, i) for i, (d, t) in enumerate(rows)], "dataset string, " + COLUMNS)
    mined = mine_templates(usage, MiningOptions(generalization_tree=True), ("dataset",))
    found = {(n.dataset, n.node): (n.depth, n.num_instances, n.num_exec, n.t_first, n.t_last) for n in mined.nodes.collect()}
    assert found == {
        ("d1", "ASK { ex:a $__PARAM_0 }"): (0, 2, 3, 0, 1), ("d1", "ASK { ex:a 1 }"): (1, 1, 1, 0, 0), ("d1", "ASK { ex:a 2 }"): (1, 1, 2, 1, 1),
        ("d2", "ASK { ex:b $__PARAM_0 }"): (0, 2, 7, 2, 3), ("d2", "ASK { ex:b 3 }"): (1, 1, 3, 2, 2), ("d2", "ASK { ex:b 4 }"): (1, 1, 4, 3, 3),
        ("d3", "ASK { ex:b 4 }"): (0, 1, 5, 4, 4),
    }
    assert {(e.dataset, e.parent, e.node) for e in mined.edges.collect()} == {(d, p, n) for d, p in (("d1", "ASK { ex:a $__PARAM_0 }"), ("d2", "ASK { ex:b $__PARAM_0 }")) for dd, n in found if dd == d and n != p}
    table = {r.text.strip(): r.num_specializations for r in stats_table(mined).collect()}
    assert table["ASK { ex:a $__PARAM_0 }"] == table["ASK { ex:b $__PARAM_0 }"] == 2 and table["ASK { ex:b 4 }"] == 0
    triples = forest_triples(mined, "http://d").collect()
    about = lambda p: [t for t in triples if t.p.endswith(p)]
    assert len(about("dc/terms/identifier")) == 7 and len({t.s for t in about("dc/terms/identifier")}) == 7
    assert len(about("specializationOf")) == 4 and len(about("isPartOf")) == 3 and len(about("shacl#path")) == 2
    values = {t.s: t.o_value for t in about("vocab#text") if "/bindings/" in t.s}
    assert sorted(values.values()) == ["1", "2", "3", "4"] and {t.s for t in about("describedByParameter")} == set(values)


def test_queries_without_a_template_are_linked(spark):
    from tessera.plans.mining import single_query_triples

    usage = _usage(spark, [("ASK { a:b 1 }", 5), ("ASK { a:c 2 }", 1), ("DESCRIBE a:d", 3)])
    mined = mine_templates(usage, MiningOptions(min_instances=2, include_simple_queries=True), ())
    got = {(t.s, t.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], t.o_value.rsplit("#", 1)[-1]) for t in single_query_triples(mined, "http://a", dataset_iri="http://d").collect()}
    q = "http://lsq.aksw.org/lsqQuery-q2"
    assert got == {("http://a", "result", q), (q, "type", "SPARQLQuery"), ("http://d", "member", q)}


def test_texts_are_cut_into_tokens_once(spark):
    usage = _usage(spark, [("ASK { a:b 1 }", 1), ("ASK { a:c 2 }", 1)])
    mined = mine_templates(usage, MiningOptions(generalization_tree=True), ())
    for df in (mined.templates, mined.instances, mined.nodes, mined.edges):
        assert "VALUES" not in df._jdf.queryExecution().executedPlan().toString()


def test_forest_rows_hold_no_texts_of_nodes(spark):
    from tessera.operators.specialize import grow_forest

    r = random.Random(3)
    rows = sorted({f"SELECT {r.choice('ab')}:x {{ {r.randrange(3)} {r.randrange(3)} }}" for _ in range(20)})
    inst = templates.generalize(_usage(spark, [(t, 1) for t in rows])).cache()
    plain = inst.orderBy("id").collect()
    want = _plain_forest([x.bindings for x in plain], plain[0].pieces, 2)
    forest = grow_forest(inst, 2, 1)
    # what is shuffled by node and candidate are hashes and bindings, and edges are reduced only where they are asked for
    assert not {"pieces", "template", "node", "preamble"} & set(forest.open_rows.columns)
    assert {x.node for x in forest.nodes.collect()} == set(want) and "reduced" not in vars(forest)
    found, names = {}, [x.id for x in plain]
    for m in forest.members.collect():
        found.setdefault(m.node, []).append(names.index(m.id))
        text = m.node
        for k, v in enumerate(m.bindings):
            text = text.replace(f"$__PARAM_{k}", v)
        assert text == plain[names.index(m.id)].text
    assert {t: sorted(ids) for t, ids in found.items()} == {t: sorted(ids) for t, ids in want.items()}
    # equal rows count, but are one text
    twice = grow_forest(inst.unionByName(inst), 4, 1).nodes
    assert {x.node: x.num_instances for x in twice.collect()} == {t: 2 * len(ids) for t, ids in want.items()}


def test_lattice_counts_by_text(spark):
    usage = _usage(spark, [(f"SELECT a:p{i} {{ {j} {k} }}", 1) for i in range(2) for j in range(2) for k in range(2)])
    texts, rows = lattice.supported_generalizations(usage, max_vars=3)
    found = rows.collect()
    # vectors and pieces belong to texts, each of which is reached in one way
    assert not {"pieces", "vector"} & set(rows.columns) and len({(x.k1, x.k2, x.instance) for x in found}) == len(found)
    assert {(x.k1, x.k2): x.num_instances for x in texts.collect()} == {k: [(x.k1, x.k2) for x in found].count(k) for k in {(x.k1, x.k2) for x in found}}
    again, more = lattice.supported_generalizations(usage.unionByName(usage), max_vars=3)
    assert again.count() == texts.count() and more.count() == len(found)


def test_lattice_with_a_ratio(spark):
    usage = _usage(spark, [(f"ASK {{ a:p{i} {j} }}", 1) for i in range(3) for j in range(2)])
    kept = lambda ratio: {r.template for r in generalize_and_aggregate(usage, MiningOptions(max_vars=2, min_binding_divergence_ratio=ratio))[0].collect()}
    assert kept(0.6) == {"ASK { $__PARAM_0 0 }", "ASK { $__PARAM_0 1 }"} and kept(0.5) > kept(0.6)
