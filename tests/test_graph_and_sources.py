from __future__ import annotations

import bz2
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import graph, ingest, stats
from tessera.operators.features import query_features, term_kind, terms_by_place, triple_patterns
from tessera.sources import rdf, sinks


def test_closure_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert graph.closure(edges).count() == 12
    assert graph.closure(edges, reflexive=True).count() == 13
    assert {r.node for r in graph.reachable(edges, spark.createDataFrame([(4,)], "n int")).collect()} == {4}


RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
FIRST, REST, NIL = f"<{RDF}first>", f"<{RDF}rest>", f"<{RDF}nil>"


def test_transitive_reduction_like_plain(spark):
    import random

    r = random.Random(6)
    for n, m in ((8, 14), (14, 60), (25, 60)):
        edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
        reach = {a: set() for a in range(n)}
        for a in reversed(range(n)):
            for x, y in edges:
                if x == a:
                    reach[a] |= {y} | reach[y]
        want = {(a, b) for a, b in edges if not any(x == a and y != b and b in reach[y] for x, y in edges)}
        assert {tuple(x) for x in graph.transitive_reduction(spark.createDataFrame(sorted(edges), "p int, n int"), "p", "n").collect()} == want


def test_crowded_hours_are_split(spark, monkeypatch):
    from datetime import datetime, timedelta

    from tessera.operators import stats

    monkeypatch.setattr(stats, "CELL_ROWS", 40)
    at = datetime(2020, 1, 1)
    rows = [("h1" if i < 300 else f"h{i % 9}", at + timedelta(seconds=(i * 37) % 7200), i, f"q{(i * 7) % 50}", f"t{i % 3}") for i in range(500)] + [(None, at, 900, "q", "t")]
    events = spark.createDataFrame(rows, "host string, ts timestamp_ntz, exec_id long, id string, template string")
    want = sorted(
        (a[0], a[4], b[4], a[1], b[1]) for a in rows for b in rows if a[0] and a[0] == b[0] and b[2] > a[2] and b[3] > a[3] and a[4] != b[4] and abs(b[1] - a[1]) <= timedelta(hours=1)
    )
    assert sorted(tuple(r) for r in stats.co_occurrences(events).collect()) == want
    side = lambda n: events.filter("host is not null").select("host", F.lit(0).alias("stretch"), F.col("exec_id").alias(f"exec_id{n}"))
    for part in stats._grid(side(1), side(2), ("host", "stretch"), "exec_id1", "exec_id2"):
        cells = part.groupBy("host", "_row", "_column").count().collect()
        assert max(c["count"] for c in cells) <= 80 and len([c for c in cells if c.host == "h1"]) > 36


def test_pairs_across_a_clock_change_and_grids_of_one_column(spark, monkeypatch):
    from datetime import datetime

    from tessera.operators import stats

    rows = [("h", datetime(2020, 11, 1, 1, 30), 1, 1, 7, "a"), ("h", datetime(2020, 11, 1, 2, 20), 2, 2, 8, "b"), ("h", datetime(2020, 11, 1, 2, 30, 0, 1), 3, 3, 9, "c")]
    events = spark.createDataFrame(rows, "host string, ts timestamp_ntz, exec_id long, id long, template long, text string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(r[1:3] for r in stats.co_occurrences(events, shown="text").collect()) == [("a", "b"), ("b", "c")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    monkeypatch.setattr(stats, "CELL_ROWS", 40)
    side = lambda n, end: spark.range(end).select(F.lit("h").alias("host"), F.lit(0).alias("stretch"), F.col("id").alias(f"exec_id{n}"))
    left, right = stats._grid(side(1, 400), side(2, 30), ("host", "stretch"), "exec_id1", "exec_id2")
    assert (left.count(), right.count()) == (400, 300)  # only what meets several parts is repeated
    assert left.join(right, ["host", "stretch", "_row", "_column"]).count() == 400 * 30


def test_pairs_are_sought_by_the_block(spark, monkeypatch):
    import random
    from datetime import datetime, timedelta

    from tessera.operators import stats

    for name, n in (("CELL_ROWS", 60), ("PACK_ROWS", 30), ("BLOCK_ROWS", 7)):
        monkeypatch.setattr(stats, name, n)
    r, at = random.Random(4), datetime(2019, 12, 31, 23)
    rows = [(r.choice(["h1", "h1", "h2", None]), at + timedelta(seconds=r.choice([600, 3600, 4200, 4200.000001, r.uniform(0, 9000)])), i, r.randrange(40), r.randrange(4)) for i in r.sample(range(9000), 500)]
    rows += [("h1", None, 9001, 99, 9), ("h1", at, None, 99, 9), ("h1", at, 9002, None, 9), ("h1", at, 9003, 99, None)]
    rows = [(*x, f"t{x[4]}" if x[4] else None) for x in rows]
    events = spark.createDataFrame(rows, "host string, ts timestamp_ntz, exec_id long, id long, template long, text string")
    whole = [x for x in rows if None not in x[:5]]
    want = [(a[0], a[5], b[5], a[1], b[1]) for a in whole for b in whole if a[0] == b[0] and b[2] > a[2] and b[3] > a[3] and a[4] != b[4] and abs(b[1] - a[1]) <= timedelta(hours=1)]
    assert sorted(map(repr, (tuple(x) for x in stats.co_occurrences(events, shown="text").collect()))) == sorted(map(repr, want))

    right = events.filter("host is not null and exec_id is not null and id is not null")
    blocks = stats._blocks(right, ["host"], "id", "exec_id", ["template"], "exec_id").collect()
    assert sorted(x.exec_id for b in blocks for x in b["rows"]) == sorted(x[2] for x in rows if None not in (x[0], x[2], x[3]))
    for b in blocks:
        ids, execs = [x.id for x in b["rows"]], [x.exec_id for x in b["rows"]]
        assert len(ids) == b.n_rows <= 7 and (min(execs), max(execs)) == (b.min_exec_id, b.max_exec_id) and b.first in execs
        assert b.min_id <= min(ids) and max(ids) <= b.max_id
    # an execution in the middle passes over most blocks
    assert sum(b.n_rows for b in blocks if b.max_id > 20 and b.max_exec_id > 4500) < 0.6 * sum(b.n_rows for b in blocks)


def test_transitive_reduction(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "p string, n string")
    assert {tuple(r) for r in graph.transitive_reduction(edges, "p", "n").collect()} == {("a", "b"), ("b", "c")}


def test_graph_queries_of_whole_tables_like_plain_version(spark, tmp_path):
    from tessera.plans import log_queries

    for name, columns, rows in (
        ("nation", "n_nationkey int, n_regionkey int", [(5, 0), (6, 0), (7, 1)]),
        ("customer", "c_custkey int, c_nationkey int", [(i, 5 + i % 3) for i in range(70)]),
        ("orders", "o_orderkey int, o_custkey int", [(i, i % 65) for i in range(140)]),
        ("lineitem", "l_orderkey int, l_linenumber int", [(i % 140, i // 140) for i in range(300)]),
    ):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    up = {f"n.{n}": f"r.{r}" for n, r in [(5, 0), (6, 0), (7, 1)]}
    up |= {f"c.{i}": f"n.{5 + i % 3}" for i in range(70)} | {f"o.{i}": f"c.{i % 65}" for i in range(140)} | {f"l.{i % 140}.{i // 140}": f"o.{i % 140}" for i in range(300)}

    def above(x):
        while x in up:
            x = up[x]
            yield x

    want = {(a, x) for x in up for a in above(x)}
    queries = log_queries.queries()
    pairs = lambda name: sorted((r.src, r.dst) for r in queries[name](spark, str(tmp_path)).collect())
    assert pairs("closure_descendants_all") == sorted(want)
    assert pairs("closure_reflexive_all") == sorted(want | {(x, x) for x in {*up, *up.values()}})
    left = sorted((r.s, r.o) for r in queries["remove_subtree_all"](spark, str(tmp_path)).collect())
    assert left == sorted((a, x) for x, a in up.items() if a != "n.5" and "n.5" not in above(a))


def test_statements_read_and_written(spark, tmp_path):
    raw = [
        '<http://a/s> <http://a/p> "x \\"y\\"\\n\\\\" .',
        '<http://a/s> <http://a/p> "v"@en .',
        '_:b <http://a/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> <http://g> .',
        "# a comment",
        "",
        "<bad iri> <http://a/p> <http://a/o> .",
        "no statement",
    ]
    path = str(tmp_path / "d.nt.bz2")
    with open(path, "wb") as f:
        f.write(bz2.compress("\n".join(raw).encode()))
    rows = rdf.read_triples(spark, path, base="http://base/").orderBy("line").collect()
    assert [r.bad for r in rows] == [False, False, False, False, True]
    assert rows[0].o_value == 'x "y"\n\\' and rows[1].o_lang == "en" and rows[2].g == "http://g" and rows[2].o_datatype.endswith("integer") and rows[3].s == "http://base/"
    good = rdf.read_triples(spark, path, base="http://base/").filter("not bad")
    lines = good.select(sinks.statement(F.col("s"), F.col("p"), F.col("o_value"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang")))
    sinks.write_triples(lines, str(tmp_path / "out"), rows_per_file=2)
    again = rdf.read_triples(spark, str(tmp_path / "out"))
    assert {(r.s, r.o_value, r.o_lang) for r in again.collect()} == {(r.s, r.o_value, r.o_lang) for r in good.collect()}


def test_csv_json_and_catalog(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,text,numOfExecutions,timeOfFirstExecution,timeOfLastExecution\n1,"SELECT ""a"",\nb",3,2020-01-01T00:00:00Z,\n')
    row = rdf.read_csv(spark, str(tmp_path / "q.csv"), rdf.QUERIES_CSV).first()
    assert row.text == 'SELECT "a",\nb' and row.numOfExecutions == 3 and row.timeOfLastExecution is None
    named = rdf.read_directory(spark, str(tmp_path), rdf.QUERIES_CSV, ".csv").first()
    assert named.name == "q"
    (tmp_path / "p.json").write_text('{"ex": "http://ex/", "f": "http://f/"}')
    assert {tuple(r) for r in rdf.read_prefixes(spark, str(tmp_path / "p.json")).collect()} == {("ex", "http://ex/"), ("f", "http://f/")}
    trig = '@prefix d: <http://d/> .\nd:g { d:a a d:T ; d:p "x", d:b . }\n d:s d:p d:o .'
    (tmp_path / "c.trig").write_text(trig)
    got = {tuple(r) for r in rdf.read_trig(spark, str(tmp_path / "c.trig")).collect()}
    assert got == {("http://d/g", "http://d/a", C.RDF_TYPE, "http://d/T"), ("http://d/g", "http://d/a", "http://d/p", "x"), ("http://d/g", "http://d/a", "http://d/p", "http://d/b"), (None, "http://d/s", "http://d/p", "http://d/o")}


def test_pairing_in_order(spark):
    sets = spark.createDataFrame([("e1", 1, "t1"), ("e1", 2, "t2"), ("e2", 3, "t3")], "e string, line int, t string")
    names = spark.createDataFrame([("e1", 5, "qA"), ("e1", 6, "qB")], "e string, line int, q string")
    assert {(r.q, r.t) for r in ingest.pair_in_order(names, sets, "e", "line").collect()} == {("qA", "t1"), ("qB", "t2")}


def test_execution_sets_in_file_order(spark):
    re = ingest.REMOTE_EXEC
    rows = [(1, re + "1", C.LSQV + "hostHash", "h1"), (2, re + "1", C.PROV + "atTime", "t1"), (3, re + "1", C.LSQV + "hostHash", "late"), (4, re + "2", C.PROV + "atTime", "t2"), (5, "http://x", C.PROV + "atTime", "no")]
    df = spark.createDataFrame([("f", *r) for r in rows], "file string, line int, s string, p string, o_value string")
    got = {(r.exec_iri, r.ts, r.host) for r in ingest.execution_sets(df).collect()}
    assert got == {(re + "1", "t1", "h1"), (re + "1", "t2", "late")}


@pytest.mark.parametrize("partition", [None, "f"])
def test_runs(spark, partition):
    values = ["a", "a", None, None, "a", "b", "b"]
    df = spark.createDataFrame([(i * 60_000, v, "x") for i, v in enumerate(values)], "i long, g string, f string")
    runs = [r.run for r in ingest.run_groups(df, "g", "i", partition).orderBy("i").collect()]
    assert [r - runs[0] for r in runs] == [0, 0, 1, 1, 2, 3, 3]


def test_runs_and_sets_across_stretches_like_plain_version(spark, monkeypatch):
    monkeypatch.setattr(ingest, "_STRETCH", 4)
    r = random.Random(5)
    rows = [(f, i * r.choice([1, 1, 3]) + 100 * k, r.choice(["a", "b", None])) for k in range(3) for i in range(0, 60, 3) for f in (["x", "y", None][k],)]
    rows = sorted({(f, i): (f, i, g) for f, i, g in rows}.values(), key=lambda t: t[1])
    want, last = {}, {}
    for f, i, g in rows:
        n, old = last.get(f, (0, object()))
        last[f] = (n + (g != old), g)
        want[f, i] = last[f][0]
    df = spark.createDataFrame(rows, "f string, i long, g string")
    assert {(x.f, x.i): x.run for x in ingest.run_groups(df, "g", "i", "f").collect()} == want

    lines, sets, name, hosts = [], set(), None, []
    for n in range(80):
        exec_iri, time = f"{ingest.REMOTE_EXEC}{n // 7}", r.random() < 0.3
        lines.append(("f", n, exec_iri, C.PROV + "atTime" if time else C.LSQV + "hostHash", f"v{n}"))
        name = name or exec_iri
        if time:
            sets |= {(name, f"v{n}", h) for h in hosts or [None]}
            name, hosts = None, []
        else:
            hosts.append(f"v{n}")
    df = spark.createDataFrame(lines, "file string, line long, s string, p string, o_value string")
    assert {(x.exec_iri, x.ts, x.host) for x in ingest.execution_sets(df).collect()} == sets


def test_entropy_and_types(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 4), ("c", None)], "k string, n long")
    assert {r.k: round(r.e, 6) for r in df.groupBy("k").agg(C.entropy(F.col("n")).alias("e")).collect()} == {"a": 1.5, "b": 0.0, "c": 0.0}
    t = spark.createDataFrame([("SELECT ?task {}",), ("DESCRIBE <x>",), ("",)], "t string")
    got = t.select(C.query_type(F.col("t")).alias("a"), C.query_type(F.col("t"), True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("A", "S"), ("D", "D"), (None, None)]


def test_terms(spark):
    prefixes = F.array(F.struct(F.lit("ex").alias("name"), F.lit("http://ex/").alias("iri")))
    df = spark.createDataFrame([("ex:a\\,b",), ("no:x",), ("<rel>",), ("<http://a>",), ('"l"@en',)], "t string")
    got = [r.r for r in df.select(C.rebase_term(F.col("t"), prefixes, F.lit("http://b/")).alias("r")).collect()]
    assert got == ["<http://ex/a,b>", None, "<http://b/rel>", "<http://a>", '"l"@en']
    cast = spark.createDataFrame([("true",), ("false",), ("x",)], "v string").select(C.cast_term(F.col("v"), F.lit(C.XSD + "boolean"), "boolean").alias("b")).collect()
    assert [r.b for r in cast] == [True, False, None]


def test_references_are_resolved(spark):
    # The examples of RFC 3986, 5.4, and some more.
    base = "http://a/b/c/d;p?q"
    want = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
        "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
        "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
        "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
        "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    }
    df = spark.createDataFrame([(r,) for r in want], "r string")
    assert {x.r: x.o for x in df.select("r", C.resolve_reference(F.col("r"), F.lit(base)).alias("o")).collect()} == want
    more = df.select("r", C.resolve_reference(F.col("r"), F.lit("http://a")).alias("o"), C.resolve_reference(F.col("r"), F.lit(None).cast("string")).alias("n")).filter("r in ('g', '../g')").collect()
    assert {x.r: (x.o, x.n) for x in more} == {"g": ("http://a/g", None), "../g": ("http://a/g", None)}


def test_features(spark):
    text = 'SELECT DISTINCT ?a { ?a ex:p "x" . OPTIONAL { ?a <http://q> ?b } VALUES ?a $v } LIMIT $n'
    f = spark.createDataFrame([(text,)], "t string").select(query_features(F.col("t")).alias("f")).first().f
    assert f.type == "S" and f.clauses == ["DISTINCT", "LIMIT", "OPTIONAL", "VALUES"] and f.variables == ["?a", "?b"]
    assert f.iris == ["<http://q>"] and f.prefixed == ["ex:p"] and f.literals == ['"x"']


def test_triple_patterns(spark):
    q = {
        "SELECT ?a WHERE { ?a ex:p \"x\"@en , 5 ; a ex:T . ?b <http://q> ?a } ORDER BY ?a LIMIT 3": [("?a", "ex:p", '"x"@en'), ("?a", "ex:p", "5"), ("?a", "a", "ex:T"), ("?b", "<http://q>", "?a")],
        "CONSTRUCT { ?s ex:b 1 } WHERE { ?s ex:c 2 }": [("?s", "ex:c", "2")],
        "ASK { ?a ex:p ?b FILTER(?b > 3 && (?b < 9)) ?b ex:q ?c OPTIONAL { ?c ex:r true } FILTER regex(?c, \"x ( y\") }": [("?a", "ex:p", "?b"), ("?b", "ex:q", "?c"), ("?c", "ex:r", "true")],
        "SELECT * { GRAPH ?g { ?a ex:p/ex:q+ ?b } { SELECT ?b WHERE { ?b ^ex:r|ex:s ?c } LIMIT 2 } UNION { ?b (ex:p|ex:q)* (1 2) } BIND(?b AS ?d) VALUES ?d { 1 } }": [
            ("?a", "ex:p/ex:q+", "?b"), ("?b", "^ex:r|ex:s", "?c"), ("?b", "()*", "_:g0"), ("_:g0", FIRST, "1"), ("_:g0", REST, "_:g1"), ("_:g1", FIRST, "2"), ("_:g1", REST, NIL)
        ],
        "ASK { ?s ex:q [ ex:r 5 ; ex:t ?z ] . [] ex:p [ ex:q ?o ] }": [("?s", "ex:q", "_:g0"), ("_:g0", "ex:r", "5"), ("_:g0", "ex:t", "?z"), ("_:g1", "ex:p", "_:g2"), ("_:g2", "ex:q", "?o")],
        "ASK { ?s ex:p () ; . FILTER NOT EXISTS { ?s ex:x ?y } MINUS { () ex:q (?s) } [ ex:a ( [] ) ] }": [
            ("?s", "ex:p", NIL), (NIL, "ex:q", "_:g0"), ("_:g0", FIRST, "?s"), ("_:g0", REST, NIL), ("_:g1", "ex:a", "_:g2"), ("_:g2", FIRST, "_:g3"), ("_:g2", REST, NIL)
        ],
        "DESCRIBE <http://a>": [], "": [], None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(q)], "i int, t string").select("i", triple_patterns(F.col("t")).alias("p")).orderBy("i")
    assert [r.p and [tuple(x) for x in r.p] for r in df.collect()] == list(q.values())
    kinds = {"?a": "variable", "'x'": "literal", "-.5": "literal", "true": "literal", "_:b": "blank", "a": "iri", "<http://a/b>": "iri", "ex:": "iri", "ex:p/ex:q": "path", "()*": "path"}
    got = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", term_kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == kinds


class _Written:
    """A random WHERE part: its text, and the patterns that it was made from."""

    def __init__(self, r):
        self.r, self.told, self.made = r, [], 0
        self.text = "SELECT * WHERE " + self.group(3)

    def blank(self):
        self.made += 1
        return f"_:b{self.made}"

    def place(self, depth, tell):
        """A term, property list or collection; ``tell`` says what stands here before what is in it."""
        kind = self.r.choice(["term", "term", "term", "list", "cells", "nil"]) if depth else "term"
        if kind == "nil":
            tell(NIL)
            return self.r.choice(["()", "( )"])
        if kind == "term":
            t = self.r.choice(["?a", "ex:b", '"x ] } (" ', "5", "<http://c#d>", "true", "$v"]).strip()
            tell(t)
            return t
        b = self.blank()
        tell(b)
        if kind == "list":
            return "[ " + (self.verbs(b, depth - 1) if self.r.random() < 0.8 else "") + " ]"
        parts, n = [], self.r.randrange(1, 4)
        cell = b
        for k in range(n):
            if k:
                following = self.blank()
                self.told.append((cell, REST, following))
                cell = following
            parts.append(self.place(depth - 1, lambda t, c=cell: self.told.append((c, FIRST, t))))
        self.told.append((cell, REST, NIL))
        return "( " + " ".join(parts) + " )"

    def verbs(self, subject, depth):
        out = []
        for _ in range(self.r.randrange(1, 4)):
            verb, shown = self.r.choice([("ex:p", "ex:p"), ("a", "a"), ("?p", "?p"), ("ex:p/ex:q*", "ex:p / ex:q*"), ("^ex:r", "^ex:r"), ("()+", "( ex:p | ^ex:q )+")])
            out.append(shown + " " + " , ".join(self.place(depth, lambda t: self.told.append((subject, verb, t))) for _ in range(self.r.randrange(1, 3))))
        return " ; ".join(out)

    def group(self, depth):
        parts = []
        for _ in range(self.r.randrange(1, 5)):
            kind = self.r.choice(["triples"] * 4 + ["optional", "graph", "filter", "bind", "sub", "union", "exists"]) if depth else "triples"
            if kind == "triples":
                held = []
                text = self.place(2, held.append)
                parts.append(f"{text} {self.verbs(held[0], 3)} .")
            elif kind in ("optional", "graph"):
                parts.append(("OPTIONAL " if kind == "optional" else "GRAPH ?g ") + self.group(depth - 1))
            elif kind == "union":
                parts.append(self.group(depth - 1) + " UNION " + self.group(depth - 1))
            elif kind == "sub":
                parts.append("{ SELECT ?a (COUNT(?b) AS ?n) WHERE " + self.group(depth - 1) + " GROUP BY ?a HAVING (?n > 2) LIMIT 3 }")
            else:
                parts.append({"filter": "FILTER(?a > 3 && (?b < 9))", "bind": "BIND(str(?a) AS ?d)", "exists": "FILTER NOT EXISTS { ?q ex:no [ ex:no ( 1 ) ] }"}[kind])
        return "{ " + " ".join(parts) + " }"


def _in_order(patterns):
    """Blank nodes by the order of the patterns that name them; the patterns as a set."""
    children = {}
    for s, p, o in patterns:
        children.setdefault(s, []).append((p, o))

    def shape(t):
        return (t.split(":")[0], tuple(sorted((p, shape(o)) for p, o in children.get(t, [])))) if t.startswith("_:") else (t,)

    return sorted((shape(s), p, shape(o)) for s, p, o in patterns)


def test_patterns_like_their_makers(spark):
    r = random.Random(11)
    made = [_Written(r) for _ in range(250)]
    df = spark.createDataFrame([(i, m.text) for i, m in enumerate(made)], "i int, t string")
    for row in df.select("i", triple_patterns(F.col("t")).alias("p")).collect():
        assert _in_order([tuple(x) for x in row.p]) == _in_order(made[row.i].told), made[row.i].text


def test_deep_brackets(spark):
    n = 60
    text = "ASK { ?s ex:p " + "[ ex:p ( " * n + "1" + " ) ]" * n + " }"
    found = spark.createDataFrame([(text,)], "t string").select(triple_patterns(F.col("t")).alias("p")).first().p
    assert len(found) == 1 + 3 * n and [x.object for x in found if x.object == "1"] == ["1"]


def test_terms_of_many_queries(spark):
    df = spark.createDataFrame([("d", "ASK { ?a ex:p ?a . ?a ex:p 1 }"), ("d", "ASK { ?a ex:q 1 }"), ("e", "ASK { 1 }"), ("e", None)], "k string, text string")
    got = {tuple(r) for r in terms_by_place(df, "k").collect()}
    assert got == {("d", "subject_object", "variable", "?a", 2), ("d", "subject_object", "literal", "1", 2), ("d", "predicate", "iri", "ex:p", 1), ("d", "predicate", "iri", "ex:q", 1)}


def test_lines_and_catalog_of_files(spark, tmp_path):
    lines = spark.createDataFrame([("<a> <Cls(b)> .",), ("<a> <b> .",), (None,)], "value string")
    assert [r.value for r in rdf.lines_without(lines, "<Cls(").collect()] == ["<a> <b> .", None]
    for name in ("one.nt", "two x+y.nt", "three.csv"):
        (tmp_path / name).write_text("x")
    got = {tuple(r) for r in rdf.catalog_of_files(spark, str(tmp_path), "http://c", "http://d/").collect()}
    names = ("http://d/one", "http://d/two x+y")
    assert got == {("http://c", "http://d/", C.SERVICE + "namedGraph", n) for n in names} | {("http://c", n, C.RDF_TYPE, C.SERVICE + "NamedGraph") for n in names}


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(12)],  # a chain
        [(i // 2, i) for i in range(1, 20) if i > 1],  # a tree
        [(i, (i + 1) % 5) for i in range(5)] + [(2, 9), (9, 10), (10, 11)],  # one parent each, with a cycle
        [(1, 1), (1, 2), (2, 3)],  # a loop
        [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (1, 6)],  # two parents
        [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (5, 3), (4, 6), (6, 7), (7, 8)],
        [(1, 2), (2, None), (None, 3), (None, None)],
        [],
    ],
)
def test_closures_of_forests_and_other_graphs(spark, edges):
    """Each pair once, whatever the graph."""
    df = spark.createDataFrame(edges * 2, "src int, dst int")
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in edges if b == c and b is not None}
        if more == want:
            break
        want = more
    got = [tuple(r) for r in graph.closure(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in graph.closure(df, reflexive=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(x, x) for e in edges for x in e}


def test_closure_of_a_forest_moves_each_pair_once(spark, monkeypatch):
    """The pairs of a forest's last round are not compared with what is known, and not kept."""
    kept = []
    whole = graph.stored
    monkeypatch.setattr(graph, "stored", lambda d: kept.append(d.count()) or whole(d))
    monkeypatch.setattr(graph, "cut", lambda d: kept.append(d.count()) or d)
    assert graph.closure(spark.createDataFrame([(i, i + 1) for i in range(4)], "src int, dst int")).count() == 10
    assert kept == [4, 3]  # the edges and the pairs at distance two; three pairs more are the last round's


def test_catalog_lists_a_table_in_parts_once(spark, tmp_path):
    """A table written in several files is a folder: one graph of its own name, whatever the parts are called."""
    folder = tmp_path / "my (1).nt" / "sf+1 a"
    spark.range(10).repartition(3).write.parquet(str(folder / "events.parquet"))
    spark.range(10).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(str(folder / "by k.parquet"))
    (folder / "one.parquet").write_text("x")
    (folder / "notes").mkdir()
    (folder / "notes" / "other.parquet").write_text("x")
    for path in (str(folder), f"file://{folder}/", f"{folder}//"):
        got = {r.o for r in rdf.catalog_of_files(spark, path, "http://c", "http://d/", ".parquet").filter("s = 'http://d/'").collect()}
        assert got == {"http://d/events", "http://d/by k", "http://d/one"}
    assert rdf.catalog_of_files(spark, str(folder), "http://c", "http://d/", ".parquet").count() == 6


def test_execution_graphs(spark):
    g = "http://d/x/execs"
    quads = [(g, "q1", "hasRemoteExec", "e1"), (g, "q1", "hasRemoteExec", "e2"), (g, "q2", "hasRemoteExec", "e3"), (g, "e1", "atTime", "t1"), (g, "e2", "atTime", "t2"), (g, "e1", "hostHash", "h"), ("http://d/y/execs", "q", "hasRemoteExec", "e")]
    quads = spark.createDataFrame([(a, s, (C.PROV if p == "atTime" else C.LSQV) + p, o) for a, s, p, o in quads], "g string, s string, p string, o string")
    catalog = spark.createDataFrame([(f"http://d/{n}", C.RDF_TYPE, C.SERVICE + "NamedGraph") for n in "xxyz"], "s string, p string, o string")
    got = [tuple(r) for r in stats.execution_graph_stats(catalog, quads, "http://d/").collect()]
    assert got == [("x", 1, 2, 1, "t1", "t2")]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    with sinks.recorded_run(spark, path, "d"):
        pass
    with pytest.raises(ValueError), sinks.recorded_run(spark, path, "e"):
        raise ValueError("no")
    assert {(r.dataset, r.status, r.error) for r in sinks.run_states(spark, path).collect()} == {("d", "Completed", None), ("e", "Failed", "no")}


def test_stream_counts_like_a_batch(spark, tmp_path):
    from tessera.streaming.usage import read_stream, template_usage_by_window

    rows = [("2024-01-01 01:00:00", "ASK { 1 }"), ("2024-01-01 02:00:00", "ASK { 2 }"), ("2024-01-02 01:00:00", "ASK { 1 }")]
    df = spark.createDataFrame(rows, "ts string, text string").select(F.to_timestamp("ts").alias("ts"), "text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    counted = template_usage_by_window(read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string"))
    run = counted.writeStream.format("memory").queryName("usage_by_day").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.window_start.day, r.template, r.num_exec) for r in spark.table("usage_by_day").collect())
    assert got == [(1, "ASK { $__PARAM_0 }", 2), (2, "ASK { $__PARAM_0 }", 1)]


def test_patterns_by_shape_are_those_of_each_text(spark, monkeypatch):
    """Texts that differ in their terms share one fold; whatever the terms are, the patterns are those of the text itself."""
    from tessera.operators import features

    shapes = [
        "SELECT * WHERE { ?s ex:p%s [ ex:q %s ; ex:r ?z , ( %s \"u\\u0001\" ) ] . [] ex:t ?s }",
        "ASK { GRAPH ?g { <http://ex.org/u%s> ex:in ( [ ex:k %s ] () ) } OPTIONAL { ?a ex:x / ( ex:y | ex:z )* ?b } FILTER NOT EXISTS { ?a ex:no [ ex:no %s ] } }",
        "SELECT ?x { { SELECT ?x WHERE { ?x ^ex:d%s / ex:e [ ex:f %s ] } GROUP BY ?x LIMIT 5 } MINUS { ?x a ex:T%s } }",
        "CONSTRUCT { ?s ex:b %s } WHERE { ?s ex:a\\/ %s ; ex:u || , ^^ . ?o !ex:c 'x%s/' }",
        "DESCRIBE <http://ex.org/%s%s%s>",
    ]
    texts = [s.replace("\\u0001", "\x01") % (i, i % 3, i * 7) for s in shapes for i in range(6)] + [None, "", "{", "SELECT * { ) ] } . a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {r.i: r.p for r in df.select("i", triple_patterns(F.col("text")).alias("p")).collect() if r.p is not None}
    for most in (features.SHAPE_CHARACTERS, 0):  # shapes broadcast, and shuffled
        monkeypatch.setattr(features, "SHAPE_CHARACTERS", most)
        got = {r.i: r.patterns for r in features.patterns_by_shape(df).collect()}
        assert got == want
    folded = []
    monkeypatch.setattr(features, "stored", lambda d: folded.append(d.count()) or d)
    assert features.patterns_by_shape(df).count() == len(texts) - 1
    assert folded == [len(texts) - 1, 7]  # all texts, and the distinct shapes that are folded


def test_assembly_reads_each_line_once(spark):
    """However often the statements are looked at, a line is parsed once; lines that say nothing about executions are not kept."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(line):
        read.add(1)
        return line

    lines = [f'<{ingest.REMOTE_EXEC}{i % 3}> <{C.LSQV}hostHash> "h" .' for i in range(4)] + [f'<{ingest.REMOTE_EXEC}1> <{C.PROV}atTime> "t" .', f"<{ingest.QUERY_PREFIX}q> <{C.LSQV}hasRemoteExec> <{ingest.REMOTE_EXEC}0> ."]
    lines += [f'<{ingest.QUERY_PREFIX}q> <{C.LSQV}text> "ASK {{ 1 }}" .', "<http://x/a> <http://x/b> <http://x/c> ."]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line long, value string")
    queries, execs = ingest.assemble(rdf.parse_lines(rows).withColumn("s", told.asNondeterministic()("s")), "http://ds")
    assert [(r.id, r.text) for r in queries.collect()] == [("q", "ASK { 1 }")]
    assert {(r.ts, r.host) for r in execs.collect()} == {("t", "h")} and execs.count() == 4
    assert read.value == len(lines)
