"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's symbols.

Positions are classed as smaller or larger than their right neighbour; the leftmost smaller ones
(LMS) begin substrings that are sorted by inducing, named, and sorted as a shorter string by
recursion; their order induces that of all suffixes. The top level, with a byte's alphabet, induces
whole buckets at a time on arrays; the shorter strings with their large alphabets go position by
position.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; the last symbol must be the only least one."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    at = np.searchsorted(change, np.arange(n - 1))
    end = change[at]
    out = np.ones(n, bool)
    out[:-1] = t[end] < t[end + 1]
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes from the order of the LMS ones, bucket by bucket."""
    n = len(t)
    count = np.bincount(t, minlength=k)
    end = np.cumsum(count)
    start = end - count
    out = np.full(n, -1, np.int64)
    by = lms[np.argsort(t[lms], kind="stable")]
    seeds = np.concatenate([[0], np.cumsum(np.bincount(t[lms], minlength=k))])
    head = start.copy()

    def push(batch: np.ndarray, want_small: bool, edge: np.ndarray) -> None:
        p = batch - 1
        p = p[p >= 0]
        p = p[small[p] == want_small]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        got = np.bincount(c, minlength=k)
        rank = np.arange(len(p)) - (np.cumsum(got) - got)[c]
        if want_small:
            out[edge[c] - 1 - rank] = p
            edge -= got
        else:
            out[edge[c] + rank] = p
            edge += got

    for c in np.flatnonzero(count):
        low = start[c]
        while low < head[c]:
            low, batch = head[c], out[low : head[c]]
            push(batch, False, head)
        if seeds[c] < seeds[c + 1]:
            push(by[seeds[c] : seeds[c + 1]], False, head)
    tail = end.copy()
    for c in np.flatnonzero(count)[::-1]:
        high = end[c]
        while high > tail[c]:
            high, batch = tail[c], out[tail[c] : high][::-1]
            push(batch, True, tail)
        if head[c] > start[c]:
            push(out[start[c] : head[c]][::-1], True, tail)
    out[0] = n - 1
    return out


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of symbols below ``k``; the last must be the only least one."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _smaller(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) == 1:
        return _induce(t, small, lms, k)
    order = _induce(t, small, lms, k)
    sorted_lms = order[is_lms[order]]
    following = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = following - lms + 1
    a, b = sorted_lms[:-1], sorted_lms[1:]
    differ = length[a] != length[b]
    live = np.flatnonzero(~differ)
    step = 0
    while len(live):
        live = live[length[a[live]] > step]
        unequal = t[a[live] + step] != t[b[live] + step]
        differ[live[unequal]] = True
        live = live[~unequal]
        step += 1
    names = np.concatenate([[0], np.cumsum(differ)])
    if names[-1] == len(lms) - 1:
        return _induce(t, small, sorted_lms, k)
    named = np.empty(n, np.int64)
    named[sorted_lms] = names
    shorter = named[lms]
    return _induce(t, small, lms[np.array(_by_position(shorter.tolist(), int(names[-1]) + 1))], k)


def _by_position(s: list[int], k: int) -> list[int]:
    """The same for lists with large alphabets."""
    n = len(s)
    if n == 1:
        return [0]
    small = [True] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    size = [0] * k
    for c in s:
        size[c] += 1
    starts, ends, total = [0] * k, [0] * k, 0
    for c in range(k):
        starts[c] = total
        total += size[c]
        ends[c] = total

    # the symbol before a position, where that is of the wanted kind; else -1
    larger = [-1] + [c if not t else -1 for c, t in zip(s, small[:-1])]
    smaller = [-1] + [c if t else -1 for c, t in zip(s, small[:-1])]

    def induce(seed: list[int]) -> list[int]:
        sa = [0] * n  # position 0 induces nothing
        tail = ends[:]
        for i in reversed(seed):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = starts[:]
        for i in sa:  # sees what it writes further on
            c = larger[i]
            if c >= 0:
                sa[head[c]] = i - 1
                head[c] += 1
        tail = ends[:]
        for i in reversed(sa):
            c = smaller[i]
            if c >= 0:
                tail[c] -= 1
                sa[tail[c]] = i - 1
        return sa

    sa = induce(lms)
    after = [0] * n
    for i, j in zip(lms, lms[1:] + [n - 1]):
        after[i] = j
    name, last, names = -1, None, [0] * n
    for i in sa:
        if after[i]:
            part = s[i : after[i] + 1]
            if part != last:
                name, last = name + 1, part
            names[i] = name
    if name + 1 == len(lms):
        order = [i for i in sa if after[i]]
    else:
        order = [lms[x] for x in _by_position([names[i] for i in lms], name + 1)]
    return induce(order)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """For each position the symbols it shares with its predecessor in suffix order, none of them ``<= stop``.

    Where the symbols to the left are equal the predecessor moves along and one symbol less is
    shared; only the other positions are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left_same = np.zeros(n, bool)
    i = np.arange(1, n)
    j = before[1:]
    ok = j > 0
    left_same[1:][ok] = (t[i[ok] - 1] == t[j[ok] - 1]) & (t[i[ok] - 1] > stop)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~left_same & (before >= 0))
    step = 0
    while len(live):
        live = live[np.maximum(live, before[live]) + step < n]
        x = t[live + step]
        live = live[(x == t[before[live] + step]) & (x > stop)]
        out[live] += 1
        step += 1
    source = np.maximum.accumulate(np.where(left_same, 0, np.arange(n)))
    return out[source] - (np.arange(n) - source) * left_same
