from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import recompression as rc
from tessera.llm import textbytes as tb

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def plain(texts, width=rc.WINDOW):
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def found(df):
    return sorted(((r.doc_id is not None, r.doc_id), r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in rc.remove_repeats(df).collect())


def wanted(rows):
    return sorted(((i is not None, i), n, gone, kept, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, gone, kept) in zip(rows, plain([t for _, t in rows])))


def _hashed(texts):
    data, at = tb.string_bytes(pa.array(texts))
    return rc._words(data, at)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 20, 4000])
def test_equal_windows_have_equal_anchors(alphabet):
    r = random.Random(alphabet)
    common = " ".join(f"c{r.randrange(alphabet)}" for _ in range(90))
    texts = [" ".join([*(f"c{r.randrange(alphabet)}" for _ in range(r.randrange(40))), common, *(f"c{r.randrange(alphabet)}" for _ in range(r.randrange(40)))]) for _ in range(12)]
    words, owner = _hashed(texts)
    window, name, place = rc.anchors(words, owner)
    anchor = {}
    for w, a, p in zip(window.tolist(), name.tolist(), place.tolist()):
        assert 0 <= p - w < rc.WINDOW
        assert anchor.setdefault(words[w : w + rc.WINDOW].tobytes(), (a, p - w)) == (a, p - w)
    assert len(window) == sum(max(0, n - rc.WINDOW + 1) for n in np.diff(owner))


def test_levels_shrink_and_names_stand_for_content():
    r = random.Random(8)
    words, owner = _hashed([" ".join(r.choice("abcdefgh") for _ in range(3000))])
    begins = np.zeros(len(words), bool)
    begins[0] = True
    symbols = rc.Symbols(words, np.arange(len(words)), np.arange(1, len(words) + 1), begins)
    for level in range(1, 7):
        before = len(symbols.name)
        runs, of = symbols.runs()
        assert (np.diff(of) >= 0).all() and of[-1] == len(runs.name) - 1 and (runs.name[1:] != runs.name[:-1]).all()
        symbols, _ = runs.pairs(runs.right_half(level))
        assert len(symbols.name) < 0.9 * before and symbols.first[0] == 0 and (symbols.after[:-1] == symbols.first[1:]).all()
        content = {}
        for name, a, b in zip(symbols.name.tolist(), symbols.first, symbols.after):
            assert content.setdefault(name, words[a:b].tobytes()) == words[a:b].tobytes()


def test_like_a_plain_version(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == wanted(rows)
    assert rc.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("alphabet", [1, 2, 5, 300])
def test_borders_runs_and_periods(spark, alphabet):
    r = random.Random(alphabet)
    word = lambda: f"v{r.randrange(alphabet)}"
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(word() for _ in range(r.randrange(0, 120)))) for i in range(40)]
    for n in (33, 34, 35, 36, 60):
        rows.append((100 + n, " ".join([*passage[:n], f"end{n}"])))
        rows.append((200 + n, "\n".join([f"start{n}", *passage[60 - n :]])))
        rows.append((300 + n, " ".join(["same"] * n)))
        rows.append((400 + n, "\t".join([f"x{n}", *["one", "two", "three"] * n])))
        rows.append((500 + n, " ".join(["left"] * n + ["right"] * n)))
        rows.append((600 + n, " ".join([f"b{n}", *["left"] * n, *["right"] * n, f"c{n}"])))
    rows += [(7, rows[0][1]), (None, rows[3][1]), (None, None), (901, ""), (902, "\x1c\x85 é é " + " ".join(passage))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)


def test_many_copies_of_one_passage(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"head{i} {passage} tail{i % 7} of {i}") for i in range(400)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)


def test_against_sql(spark, sf_dir, duck):
    got = sorted(tuple(r) for r in rc.op13_recompression_dedup(spark, sf_dir).collect())
    assert got == sorted(duck.execute(rc.ORACLE_RECOMPRESSION).fetchall())
