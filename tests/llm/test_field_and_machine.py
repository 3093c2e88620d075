"""The semi-Markov field and the factorization machine against their definitions, written out in full."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessera.llm import pii, toxicity

TEXTS = ["call +1 (555) 123-4567.", "a1b@c2.org 10.2.3.4", "4111 1111 11", "x@y 1.2", "7.8.9.1+49123456789"]


def _weights(text, seed):
    r, edges = random.Random(seed), pii._edges(text)
    features = sorted({x for *_, f in pii._candidates(text, edges) for x in f})
    return {x: r.uniform(-1, 1) for x in features} | {"touch": r.uniform(-1, 1)}


def _segmentations(text, w):
    """(score, segments) of every way to lay candidates side by side, none over another."""
    edges = pii._edges(text)
    cands = [(i, j, kind, f, sum(w.get(x, 0.0) for x in f)) for i, j, kind, f in pii._candidates(text, edges)]

    def after(end, touching):
        yield 0.0, []
        for c in cands:
            if c[0] >= end:
                met = w.get("touch", 0.0) if touching and c[0] == end else 0.0
                for score, rest in after(c[1], True):
                    yield c[4] + met + score, [(c, met != 0.0), *rest]

    return edges, list(after(0, False))


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("seed", range(3))
def test_decoding_finds_the_best_segmentation(text, seed):
    w = _weights(text, seed)
    edges, ways = _segmentations(text, w)
    best, segments = max(ways, key=lambda x: x[0])
    assert pii._decode(text, w) == [(c[2], edges[c[0]], edges[c[1]]) for c, _ in segments]
    assert len(ways) > 1 and best >= 0


@pytest.mark.parametrize("text", TEXTS)
def test_gradient_is_that_of_the_likelihood(text):
    """For spans that lie apart, as those of the training examples do: the gradient counts no touching ones among them."""
    w = _weights(text, 7)
    edges, ways = _segmentations(text, w)
    gold = max((x for x in ways if not any(t for _, t in x[1])), key=lambda x: len(x[1]))[1]
    spans = [(c[2], edges[c[0]], edges[c[1]]) for c, _ in gold]
    got = pii._gradient(text, spans, w)
    top = max(s for s, _ in ways)
    z = top + math.log(sum(math.exp(s - top) for s, _ in ways))
    want: dict = {}
    for score, segments in [*ways, (None, gold)]:
        p = 1.0 if score is None else -math.exp(score - z)
        for c, _ in segments:
            for x in c[3]:
                want[x] = want.get(x, 0.0) + p
    for x, d in want.items():
        assert got.get(x, 0.0) == pytest.approx(d, abs=1e-4)
    touching = -sum(math.exp(s - z) * sum(t for _, t in segs) for s, segs in ways)
    assert got.get("touch", 0.0) == pytest.approx(touching, abs=1e-4)


def test_spans_of_the_training_examples_lie_apart():
    for _, gold in pii._examples(2000):
        assert all(b[1] > a[2] for a, b in zip(sorted(gold, key=lambda s: s[1]), sorted(gold, key=lambda s: s[1])[1:]))


def test_machine_is_the_sum_over_all_pairs():
    r = np.random.default_rng(2)
    w, v, bias = r.normal(size=40), r.normal(size=(40, 5)), 0.3
    terms = [sorted(r.choice(40, size=k, replace=False)) for k in (0, 1, 2, 9, 30)]
    text = np.repeat(np.arange(5), [len(t) for t in terms])
    got, _ = toxicity._raw(bias, w, v, text, np.concatenate(terms).astype(np.int64), 5)
    want = [bias + sum(w[a] for a in t) + sum(float(v[a] @ v[b]) for a in t for b in t if a < b) for t in terms]
    assert np.allclose(got, want)
