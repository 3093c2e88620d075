from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup, repeats, suffixes
from tessera.llm import textbytes as tb
from tests.llm.brute import near_components, remaining_bytes, shingle_set


def test_sketch_fills_and_estimates():
    r = np.random.Generator(np.random.PCG64(1))
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 3000)] + [np.zeros(0, np.uint64)]
    out = neardup.sketch(sets)
    assert (out[:-1] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (out[-1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    a = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
    for shared in (100, 250, 350):
        b = np.unique(np.concatenate([a[:shared], r.integers(0, 2**63, 400 - shared, dtype=np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = neardup.sketch([a, b], 2048)
        assert abs((x == y).mean() - j) < 0.06
    assert (neardup.sketch([a])[0] == neardup.sketch([sets[3], a])[1]).all()


def test_sets_like_plain_version():
    import pyarrow as pa

    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "B", "é", "x y", "\x1c", "To", "to"]) for _ in range(r.randrange(12))) for _ in range(300)] + ["", None, " \t", "To To To To To of of of of of to to"]
    for i, j, data, at in tb.chunks(pa.array(texts), 200):
        for t, s in zip(texts[i:j], neardup.document_sets(data, at)):
            assert len(s) == len(shingle_set(t)), t


def test_components_like_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = near_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op9_minhash_neardup(spark, sf_dir).collect()}
    assert got == want


def test_hub_and_chain_of_near_copies(spark):
    r = random.Random(9)
    words = [f"word{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 150):
        w = list(words)
        for _ in range(5):
            w[r.randrange(120)] = f"edit{i}x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(80)]
    for i in range(20):
        rows.append((1000 + i, " ".join(chain)))
        chain[4 * i % 80] = f"new{i}"
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_components(rows)


def test_threshold_is_inclusive(spark):
    # 7 of 8 shingles shared on one side: 6 / 8 = 0.75 exactly, then just below
    a = [f"w{i}" for i in range(11)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:10], "z"]))]
    sets = [shingle_set(t) for _, t in rows]
    both, either = len(sets[0] & sets[1]), len(sets[0] | sets[1])
    assert 100 * both >= 75 * either
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1}


def test_odd_documents(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    comp = {r.doc_id: r.component_id for r in rows}
    assert comp[2] == comp[3] == comp[4] == 1 and comp[9] == 8 and comp[5] == 5 and comp[6] == 6 and comp[7] == 7 and comp[None] is None
    assert all(r.kept for r in rows if r.doc_id is None)
    kept = neardup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    # 11 and 12 share 56 of 61 shingles
    want = near_components([(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None])
    assert comp[12] == 11 and {i: c for i, (_, c) in want.items()} == {i: c for i, c in comp.items() if i is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-5, 1, 5, 6, 7, 8, 10, 11, 13, 14]
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.deduplicate(no_docs).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_near_second_texts_of_one_id(spark):
    a, b, c = ([f"{k}{i}" for i in range(60)] for k in "abc")
    near = lambda w: " ".join([*w[:30], "x", *w[31:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(c)), (2, near(a)), (3, near(b)), (4, near(c)), (5, None), (5, near(a)), (5, near(b))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 1), (5, 5)]


def test_no_link_missed_around_the_threshold(spark):
    # pairs of 0.75 to 0.85 and above, each pair on its own
    r = random.Random(12)
    rows = []
    for i in range(400):
        w = [f"p{i}w{k}" for k in range(r.randrange(60, 200))]
        rows.append((2 * i, " ".join(w)))
        for k in range(r.randrange(1, max(3, len(w) // 18))):
            w[r.randrange(len(w))] = f"edit{k}"
        rows.append((2 * i + 1, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    alike = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(400)]
    assert sum(0.75 <= x < 0.85 for x in alike) > 60 and sum(x < 0.75 for x in alike) > 60
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_components(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "EXTRA_STARS", 0)
    r = random.Random(2)
    rows = []
    for i in range(60):
        w = [f"word{k}" for k in range(100)]
        for _ in range(3):
            w[r.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_components(rows)


def test_no_group_holds_all_outsiders(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "BLOCK", 32)
    n = 640
    large = spark.range(n).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("node"), F.when(F.col("id") < 5, 0).otherwise(F.col("id")).alias("component"), F.lit(n).cast("long").alias("size"))
    sketches = large.select("node", F.lit(bytes(neardup.COORDINATES)).alias("sketch"))
    tiles = neardup._tiles(large, sketches)
    groups = tiles.groupBy("bucket", "at", "by").count().collect()
    assert len(groups) == 20 * 20 and max(g["count"] for g in groups) <= 4 * 32
    met = tiles.filter("not guest").select("at", "by", F.col("node").alias("x")).join(tiles.filter("guest").select("at", "by", F.col("node").alias("y")), ["at", "by"])
    assert met.count() == met.select("x", "y").distinct().count() == n * (n - 5)


@pytest.mark.parametrize("alphabet", [1, 2, 4, 250])
def test_suffix_array_and_prefixes(alphabet):
    r = random.Random(alphabet)
    for _ in range(150):
        t = [r.randrange(1, alphabet + 2) for _ in range(r.randrange(1, 50))] + [0]
        order = suffixes.suffix_array(np.array(t), 256)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffixes.permuted_common_prefixes(np.array(t), order, 1)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist()):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k] > 1:
                k += 1
            assert shared[i] == k


def _removed(docs):
    plain = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id is not None, r.doc_id, len((r.text or "").encode()), n, s, hashlib.sha256(k).hexdigest()) for r, (k, n, s) in zip(plain, remaining_bytes([r.text for r in plain])))
    got = sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    assert got == want


def test_repeats_like_plain_version(spark, sf_dir):
    _removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_repeats_of_odd_documents(odd_docs, no_docs):
    _removed(odd_docs.withColumn("text", F.expr("if(doc_id = 10, substr(text, 1, 60000), text)")))
    assert repeats.remove_repeats(no_docs).count() == 0


def test_rows_of_one_id(spark):
    """Texts of equal CRC32 under one doc_id or none: only what repeats goes."""
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    head, met, pair = noise(550), {}, None
    while pair is None:
        tail = f"{r.randrange(10**10):010}"
        crc = zlib.crc32(tail.encode(), zlib.crc32(head.encode()))
        if met.setdefault(crc, tail) != tail:
            pair = (head + met[crc], head + tail)
    a, b = (t[340:] for t in pair)  # 210 bytes that share their first 200
    for one, two in ((None, 7), (5, 5)):
        _removed(spark.createDataFrame([(one, noise(560)), (one, noise(560)), (two, noise(560)), (one, a), (one, b), (one, noise(300)), (one, None)], "doc_id long, text string"))
    x = "x" * 549 + "z"
    y = noise(560)
    _removed(spark.createDataFrame([(None, x), (None, y), (7, x), (None, y[:199]), (None, None), (None, pair[0]), (5, pair[1])], "doc_id long, text string"))


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_at_borders_and_in_periods(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "SHARD_PIECES", hot)
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p = noise(450)
    rows = [noise(100) + p[:199], p[:199] + noise(90), noise(80) + p[:200] + noise(80), p[3:] + noise(20), noise(30) + p, p, "ab" * 400, "ab" * 150, "é" * 120, "x" + "é" * 100, "z" * 199, "z" * 200, noise(300) + p[100:320] + noise(300) + p[200:420]]
    for i in range(12):
        q = list(p)
        q[r.randrange(450)] = "#"
        rows.append("".join(q))
    _removed(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
