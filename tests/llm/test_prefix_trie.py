from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import prefix_trie as pt

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(t)] for c, t in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    total = {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        saved = (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        total[k] = (sum(total[x][0] for x in below) if below else 1, saved + sum(total[x][1] for x in below))
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), *total[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    }


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(seed, n, turns, words=3):
    r = random.Random(seed)
    return [(c, k if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice([" ".join("w" * r.randrange(words)), "a b", None, "x"])) for c in range(-30, n) for k in range(r.randrange(1, turns)) if r.random() < 0.9]


def distinct_places(rows):
    """One row a place, so that the order of turns is the same for all."""
    seen = {}
    for row in rows:
        seen.setdefault(row[:2], row)
    return list(seen.values())


def test_like_a_plain_version(spark):
    rows = distinct_places(made_up(3, 150, 9)) + [(None, 0, "user", "no conversation")]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("stretch", [2, 7, 4096])
def test_long_conversations_copies_and_a_common_start(spark, monkeypatch, stretch):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    monkeypatch.setattr(pt, "CHUNK", 5)
    monkeypatch.setattr(pt, "HOT", 12)
    rows = []
    for c in range(60):  # a third are copies of one conversation, the others share its first turns and part later
        rows += [(20 * c, k, "user", f"same {k} words") for k in range(30 if c % 3 else 30 - c % 7)]
        if c % 3:
            rows += [(20 * c, 100 + k, "user", f"own {c % 9} {k}") for k in range(c % 5)]
    rows += [(2001, k, "user", "a b c") for k in range(50)] + [(2002, 0, None, None), (2003, None, "user", "x"), (2003, 0, "user", "y")]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_ties_and_repeated_rows_are_turns(spark):
    rows = [(5, 1, "user", "b"), (5, 1, "user", "b"), (5, 1, "user", "b"), (5, None, "user", "a"), (40, 0, "user", "z")] + [(41, 0, "user", "z")] * 9
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    tied = [(7, 1, "user", t) for t in "qwertyuiop"]
    one, other = (got(pt.prefix_trie(spark.createDataFrame(x, SCHEMA))) for x in (tied, tied[::-1]))
    assert one == other and len(one) == len(plain(tied))


def test_empty_table_and_clashing_names(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a")]
    wide = spark.createDataFrame([(*r, 9, "x", 7) for r in rows], SCHEMA + ", depth long, row_num string, level long")
    assert got(pt.prefix_trie(wide)) == plain(rows)


def test_rounds_are_logarithmic(spark):
    # a comb: every turn has a side branch, so the tree is as deep as it is wide
    rows = [(20 * c, k, "user", f"t{k}" if k < c else f"end{c}") for c in range(1, 65) for k in range(c + 1)]
    nodes, _, _ = pt.trie(pt.rebuilt_turns(spark.createDataFrame(rows, SCHEMA)))
    assert nodes.agg({"level": "max"}).first()[0] <= 7


def test_against_sql(spark, sf_dir, duck):
    want = {tuple(r) for r in duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({pt.ORACLE_PREFIX_TRIE})").fetchall()}
    assert got(pt.op12_prefix_trie(spark, sf_dir)) == want
