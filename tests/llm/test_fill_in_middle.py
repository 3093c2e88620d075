from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle as fim

PLAIN = {
    "characters": r"(?s).",
    "words": "[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*|[\\x20\\x09-\\x0D]+",
    "lines": "[^\\n]+\\n*|\\n+",
    "tokens": "[^\\W\\d_]+[\\x20\\x09-\\x0D]*|\\d+[\\x20\\x09-\\x0D]*|[\\x20\\x09-\\x0D]+|[\\s\\S]",
}
TEXTS = ["", None, " ", "\n\n", "a", "one two", "  lead  and trail \t", "a\n\nb\nc", "x🙂🙂y 🙂", "é1 22b,c;; d", "no blank", "\r\n\r\n", "1a 2 b3  ", "\U0010ffff\x00z", "w" * 3000 + " 🙂" * 500]


@pytest.mark.parametrize("grammar", list(PLAIN))
def test_units_like_a_plain_matcher(spark, grammar):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", fim.units(F.col("text"), grammar).alias("u")).collect()
    for r in rows:
        assert r.u == re.findall(PLAIN[grammar], r.text or ""), (grammar, r.text)


def plain(doc_id, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_like_a_plain_version(spark, odd_docs, no_docs):
    more = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(900 + i, f"a{m}b🙂 <") for i, m in enumerate(["<P>", "<S>", "<M>", "<", "S>", "<<S", ">"] * 5)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = fim.transform(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(repr((r.doc_id, *plain(r.doc_id, r.text), r.text or "")) for r in docs.collect())
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(odd_docs).count() == odd_docs.count() and fim.transform(no_docs).count() == 0


@pytest.mark.parametrize("grammar", ["words", "lines", "tokens"])
def test_every_grammar_is_restored(spark, grammar):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 4)], "doc_id long, text string")
    out = fim.transform(docs, grammar).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert all(r.n == len(re.findall(PLAIN[grammar], r.text)) for r in out)


def test_pieces_are_made_once(spark, sf_dir):
    plan = fim.op11_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("split(") == 2


def test_against_sql(spark, sf_dir, duck):
    got = {tuple(r) for r in fim.op11_fill_in_middle(spark, sf_dir).collect()}
    assert got == set(duck.execute(fim.ORACLE_FILL_IN_MIDDLE).fetchall())
