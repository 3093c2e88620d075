"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = WORD.findall((text or "").translate(_LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows: list[tuple[int, str | None]], tried: list | None = None) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least doc_id of its component)."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared: dict = {}
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for rank, (kind, rx) in enumerate(_BASE.items()):
        for m in re.finditer(rx, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            out.append((m.start(), rank, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def remaining_bytes(texts: list[str | None], length: int = 200) -> list[tuple[bytes, int, int]]:
    """Of each text: remaining bytes, removed bytes, removed runs."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((bytes(b for b, g in zip(r, gone) if not g), sum(gone), runs))
    return out
