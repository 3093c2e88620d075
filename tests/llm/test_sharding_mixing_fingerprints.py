from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, mixing, sharding
from tests.llm.brute import WORD


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, inverse=True).tolist() == list(range(n))
    assert p.tolist() == [sharding.place(i, n, 1)[1] for i in range(n)]
    assert all(sharding.row_at(*sharding.place(i, n, 8), n, 8) == i for i in range(min(n, 50)))


def test_permutation_shuffles():
    p = sharding.permute(np.arange(100_000), 100_000)
    assert abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02
    assert (sharding.permute(np.arange(1000), 1000, key=1) != sharding.permute(np.arange(1000), 1000, key=2)).mean() > 0.9


def test_shards(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 8).collect()
    again = sharding.shard_documents(odd_docs.repartition(3), 8).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id, r.text_crc32, r.slot, r.shard)
    assert sorted(rows, key=key) == sorted(again, key=key)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(8)) <= 1
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by_id = sorted(rows, key=lambda r: r.row_num)
    assert [r.row_num for r in by_id] == list(range(len(rows))) and by_id[0].doc_id is None
    assert sharding.shard_documents(no_docs, 8).count() == 0


def _plain_targets(sizes: dict, most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while True:
        level = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over


def test_targets_like_plain_version(spark):
    sizes = {"a": 10, "b": 1000, "é": 30, "z": 5, None: 400, "": 0, "c": 77}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    for s, t in _plain_targets(sizes).items():
        assert got[s] == pytest.approx(t)


def test_mix(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    plain = odd_docs.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in plain)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)
    assert mixing.mix(no_docs).count() == 0
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd_docs.repartition(2)).collect()))


def test_mix_is_near_its_targets(spark):
    big = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text")
    )
    # by source: two of them have the same size and target
    per = mixing.mix(big).join(big.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 13 for r in per)
    texts = mixing.mixed_documents(big)
    assert texts.columns == big.columns
    assert texts.agg(F.sum(mixing.word_count())).first()[0] == sum(r.taken for r in per)


def test_sources_of_repeated_and_null_ids_meet_their_targets(spark, monkeypatch):
    # source "b" has one id for all rows, source "c" none, source "d" one row 300 times
    monkeypatch.setattr(mixing, "COPIES", 64)
    rows = [(i, f"t{i} of four words", "a") for i in range(300)] + [(77, f"u{i} of four words", "b") for i in range(300)]
    rows += [(None, f"v{i} of four words", "c") for i in range(300)] + [(None, "again and again this", "d")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.source_targets(docs.select("source", mixing.word_count().alias("size"))).collect()}
    assert {s: round(t) for s, t in target.items()} == {"a": 686, "b": 1371, "c": 2057, "d": 686}
    mixed = {r.source: r.taken for r in mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count()).alias("taken")).collect()}
    # all texts have four words; ids tell sources apart but for c and d, which the targets do
    per = mixing.mix(docs).groupBy(F.when(F.col("doc_id") < 300, "ab").alias("ids"), (F.col("doc_id") == 77).alias("hot"), "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in per) == 1200
    assert all(abs(mixed[s] - t) <= 4 for s, t in target.items())
    got = [(r.hot, r.target, r.taken) for r in per]
    assert abs(next(t for hot, goal, t in got if hot and round(goal) == 1371) - 1371) <= 4
    assert abs(next(t for hot, goal, t in got if hot is None and round(goal) == 2057) - 2057) <= 4
    assert abs(next(t for hot, goal, t in got if hot is None and round(goal) == 686) - 686) <= 4


def test_takes_like_a_plain_threshold_walk(spark):
    r = random.Random(5)
    rows = [(i % 900, " ".join(["w"] * r.randrange(0, 30)) + f" {i % 1100}", r.choice("aaaabc")) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = docs.select("doc_id", "source", mixing.word_count().alias("size"), mixing.row_key(docs).alias("hash")).groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    hashed = mixing._with_copies(groups, "hash").withColumn("prefix", mixing.hash_prefix(F.col("hash"), F.col("copy")))
    plain = hashed.select("source", "size", "prefix").collect()
    sizes = Counter()
    for x in plain:
        sizes[x.source] += x.size
    want = Counter()
    for source, target in _plain_targets(dict(sizes)).items():
        times = min(int(target // max(sizes[source], 1)), 3)
        left, used, below = target - times * sizes[source], 0, 0
        buckets = Counter()
        for x in plain:
            if x.source == source:
                buckets[x.prefix] += x.size
        for at in sorted(b for b in buckets if buckets[b]):
            if used + buckets[at] > left:
                below = at + (left - used > buckets[at] / 2)
                break
            used += buckets[at]
        for x in plain:
            if x.source == source:
                want[source, x.size, x.size * min(times + (x.prefix < below), 3)] += 1
    sized = {round(t, 6): s for s, t in _plain_targets(dict(sizes)).items()}
    got = Counter((sized[round(x.target, 6)], x.size, x.taken) for x in mixing.mix(docs).collect())
    assert got == want


def test_mixed_documents_keep_columns(odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert mixing.mixed_documents(no_docs).count() == 0


def _canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def test_fingerprints_like_plain_version(odd_docs):
    plain = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    rows = fingerprints.fingerprint_documents(odd_docs).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    prints, texts = {}, defaultdict(set)
    for k, (i, text) in enumerate(plain):
        nxt = plain[(k + 1) % len(plain)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + nxt[:h]
        mine = [r for r in got[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert mine, (i, text[:30])
        r = mine[0]
        assert r.n_chars == len(text)
        assert r.near_edited == float(_canonical(text) == _canonical(edited)) and r.near_next == float(_canonical(text) == _canonical(nxt))
        prints[text] = r.fingerprint
        texts[r.fingerprint].add(_canonical(text))
    assert len(rows) == len(plain) and all(len(t) == 1 for t in texts.values())
    assert prints["one two"] == prints["ONE two"] and len(set(prints.values())) == len({_canonical(t) for t in prints})


def test_fingerprints_of_small_tables(spark, no_docs):
    assert fingerprints.fingerprint_documents(no_docs).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_many_ranges(spark):
    docs = spark.range(3000).select((F.col("id") * F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    nexts = {r.doc_id: r.next_text for r in fingerprints.with_next(docs).collect()}
    assert nexts == {i * i: f"t{(i + 1) % 3000}" for i in range(3000)}


def test_colliding_hashes_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "doc_id long, text string")
    weak = lambda c: F.when(c == "c", F.lit("y")).otherwise(F.lit("x"))
    shared = fingerprints.colliding_texts(docs, weak)
    assert [r.hash for r in shared.collect()] == ["x"]
    rows = docs.select("doc_id", F.col("text").alias("_c"), F.col("text").alias("_e"), weak(F.col("text")).alias("fingerprint"), weak(F.col("text")).alias("edited_fingerprint"))
    told = {r.doc_id: r.fingerprint for r in fingerprints._tell_apart(rows, docs, shared).collect()}
    assert told[1] != told[2] == told[3] and told[4] == "y"
