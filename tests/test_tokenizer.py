from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import tokenizer as tk

SAMPLE = """BASE <http://harbour.example/>
prefix ship: <http://harbour.example/ship#>
# ships that came in late
select distinct ?vessel ?flag where {
  ?vessel ship:berth 17 ; ship:draught 6.25 , -3e1 .
  ?vessel ship:motto 'slow & "sure"'@en-GB ; ship:built "1987"  ^^ ship:year . # ship:hidden
  values (?flag) { (<flags/no>) ("dk") }
  filter(?flag != <flags/none> && ?a<5)
}"""


def _spark(spark, texts, options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.d for r in df.select("i", tk.decompose(F.col("t"), options).alias("d")).orderBy("i").collect()]


def test_constants_of_the_sample():
    pieces, constants, preamble = tk.decompose_text(SAMPLE)
    assert constants == [
        "ship:berth", "17", "ship:draught", "6.25", "-3e1", "ship:motto", "'slow & \"sure\"'@en-GB", "ship:built", '"1987"^^ship:year', '{ (<flags/no>) ("dk") }', "<flags/none>", "5"
    ]
    assert len(pieces) == 13 and preamble.count("<") == 2 and pieces[0].startswith("select distinct ?vessel")
    # without tags and datatypes a literal's type is a constant of its own
    assert len(tk.decompose_text(SAMPLE, tk.TokenOptions(sparql_parameters=False))[1]) == 13


def test_expressions_agree_with_python(spark):
    r = random.Random(11)
    alphabet = ["SELECT", "VALUES", "{", "}", '"', "'", "<", ">", " ", "\n", "#", "a:b", "1", ".", "@en", "^^", "?x", "_:", "\\", "PREFIX", "-", "é", "ASK", "a:", "3.5e2"]
    texts = [SAMPLE, "", "no query", "ASK", "select ?s { VALUES ?x { 1 2", "INSERT DATA { <a> <b> 1 } SELECT 2", "SELECT ?task { ?a<5 . ?b <iri> +7 ?x-5 }"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(800)]
    for options in (tk.TokenOptions(), tk.TokenOptions(exclude_preamble=False, sparql_parameters=False), tk.TokenOptions(max_tokens=6)):
        for text, got in zip(texts, _spark(spark, texts, options)):
            assert (got.pieces, got.constants, got.preamble) == tk.decompose_text(text, options), text


def test_lossless_and_long(spark):
    options = tk.TokenOptions(exclude_preamble=False, sparql_parameters=False)
    texts = [SAMPLE, 'SELECT "' + 'x\\"' * 60_000 + '" {', "SELECT " + "VALUES ?a {" + '"a" ' * 40_000 + "}", "SELECT " + "(" * 50_000, None]
    for text, got in zip(texts, _spark(spark, texts, options)):
        if text is None:
            assert got is None
        else:
            assert got.pieces[0] + "".join(c + p for c, p in zip(got.constants, got.pieces[1:])) == text


def test_prologue_parts(spark):
    row = spark.range(1).select(tk.prologue_prefixes(F.lit("BASE <http://b/> # x\nPREFIX a: <http://a/> prefix : <http://e/>")).alias("p"), tk.prologue_base(F.lit("BASE <http://b/>")).alias("b"), tk.is_prologue(F.lit("PREFIX a <x>")).alias("bad")).first()
    assert [(x.name, x.iri) for x in row.p] == [("a", "http://a/"), ("", "http://e/")] and row.b == "http://b/" and not row.bad


def test_a_preamble_is_judged_once(spark):
    """A text without a query word is all preamble: it is matched from its start, once, and not searched through."""
    df = spark.createDataFrame([("PREFIX a: <b> # c\n BASE <d>",), ("plain words PREFIX a: <b>",), (" \n",), ("x PREFIX a: <b> ASK { 1 }",), ("prefix a:<b>ASK { 1 }",)], "t string")
    found = df.select(tk.decompose(F.col("t")).alias("d"))
    assert found._jdf.queryExecution().analyzed().toString().count("(?i:PREFIX)") == 1
    assert [(r.d.pieces[0], r.d.preamble) for r in found.collect()] == [
        ("", "PREFIX a: <b> # c\n BASE <d>"), ("plain words PREFIX a: <b>", ""), ("", " \n"), ("x PREFIX a: <b> ASK { ", ""), ("ASK { ", "prefix a:<b>")
    ]
