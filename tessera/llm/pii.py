"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns match greedily and do not retry, so a card that is followed by an address, or two numbers
side by side, are lost as one bad match. The field looks at the whole neighbourhood of digits and @
signs: candidate segments of at most ``MAX_TOKENS`` tokens get a score from features of the whole
span (form, number of digits, check sum, octets, neighbours), and a dynamic programme over segment
ends picks the segments and their types together. Weights are learned from synthetic
neighbourhoods by conditional likelihood. Spans of the patterns always stay; the field's are added
where they overlap none of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, mapped_rows, table

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Tokens in a segment, characters between two anchors of one neighbourhood, characters around it.
MAX_TOKENS, GAP, AROUND = 24, 12, 64
EPOCHS, RATE, DECAY, EXAMPLES = 12, 0.3, 1e-3, 400

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match that began inside a run of digits would also begin before it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 - 9 * (d > 4) if i % 2 else d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and non-overlapping by kind, failing ones dropped."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        # the local part is the run of its characters before the sign, after the match before
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], _RANK[s[0]], s[2]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- the field -----------------------------------------------------------------------------------


def _neighbour(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "word" if c.isalnum() or c == "_" else c if c in "+-.@(:=" else "other"


def _candidate_features(kind: str, text: str, a: int, b: int) -> list[str] | None:
    """Features of the whole span under a kind; None if it cannot be one."""
    s = text[a:b]
    f: list[str] = []
    if kind == "email":
        if s.count("@") != 1 or s[0] == "@" or s[-1] in "@.":
            return None
        local, host = s.split("@")
        ok = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+", local) and _DOMAIN.fullmatch(host))
        f.append(f"form{ok}")
        f.append(f"tld{bool(re.search(r'[.][A-Za-z]{2,}$', host))}")
    elif kind == "ip":
        if not re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s):
            return None
        f.append(f"octets{_octets(s)}")
    else:
        d = _digits(s)
        if kind == "card":
            if not 12 <= len(d) <= 19 or not re.fullmatch(r"[0-9](?:[ -]?[0-9])+", s):
                return None
            f.append(f"luhn{luhn(d)}")
            f.append("usual" if len(d) in (15, 16) else "unusual")
            groups = re.split("[ -]", s)
            even = len(groups) == 1 or len(set(re.findall("[ -]", s))) == 1 and (len({len(g) for g in groups}) == 1 or [len(g) for g in groups] == [4, 6, 5])
            f.append(f"even{even}")
            f.append(f"one{len(groups) == 1}")
        else:
            if not 9 <= len(d) <= 15 or not re.fullmatch(r"\+?[0-9(][ ().0-9-]*[0-9]", s) or s.count("(") != s.count(")"):
                return None
            groups = re.findall("[0-9]+", s)
            f.append(f"plus{s[0] == '+'}")
            f.append(f"paren{'(' in s}")
            f.append(f"grouped{len(groups) > 1}")
            f.append(f"short{max(map(len, groups)) <= 4}")
            f.append(f"last{len(groups[-1])}" if len(groups) > 1 else "last-")
            f.append(f"dots{'.' in s}")
            f.append(f"octets{bool(re.search(r'[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', s))}")
            f.append(f"lead{s[0] == '+' and len(groups[0]) <= 3}")
            f.append(f"many{len(d) > 13}")
    f.append("L" + _neighbour(text[a - 1 : a]))
    f.append("R" + _neighbour(text[b : b + 1]))
    f.append("bias")
    return [f"{kind}/{x}" for x in f]


def _candidates(text: str, edges: list[int]) -> list[tuple[int, int, str, list[str]]]:
    """Token index of start and end, kind, features; tokens of a segment are bounded."""
    out = []
    n = len(edges) - 1
    for i in range(n):
        c = text[edges[i]]
        if c.isspace() or c in "@.-)" or not (c.isalnum() or c in "+(_%"):
            continue
        ats = 0
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            last = text[edges[j] - 1]
            ats += last == "@"
            if last == "\n" or ats > 1:
                break
            if not last.isalnum():
                continue
            for kind in KINDS:
                if (kind == "email") != (ats == 1) or (kind != "email" and not (c.isdigit() or c in "+(")):
                    continue
                f = _candidate_features(kind, text, edges[i], edges[j])
                if f:
                    out.append((i, j, kind, f))
    return out


def _edges(text: str) -> list[int]:
    return [m.start() for m in _TOKEN.finditer(text)] + [len(text)]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _decode(text: str, w: dict[str, float]) -> list[Span]:
    """The best segmentation; a second segment right after a first pays ``w["touch"]``."""
    edges = _edges(text)
    n = len(edges) - 1
    ends: dict[int, list] = {}
    for i, j, kind, f in _candidates(text, edges):
        ends.setdefault(j, []).append((i, kind, sum(w.get(x, 0.0) for x in f)))
    if not ends:
        return []
    out, inside = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
    back: list = [None] * (n + 1)
    from_inside = [False] * (n + 1)
    touch = w.get("touch", 0.0)
    for j in range(1, n + 1):
        from_inside[j] = inside[j - 1] > out[j - 1]
        out[j] = max(out[j - 1], inside[j - 1])
        for i, kind, score in ends.get(j, ()):
            free, next_to = out[i] + score, inside[i] + score + touch
            if max(free, next_to) > inside[j]:
                inside[j], back[j] = max(free, next_to), (i, kind, next_to > free)
    spans, j, seg = [], n, inside[n] > out[n]
    while j > 0:
        if seg:
            i, kind, seg = back[j]
            spans.append((kind, edges[i], edges[j]))
            j = i
        else:
            seg = from_inside[j]
            j -= 1
    return spans[::-1]


def _gradient(text: str, gold: list[Span], w: dict[str, float]) -> dict[str, float]:
    """Of the conditional log likelihood: gold feature counts less expected ones."""
    edges = _edges(text)
    n = len(edges) - 1
    place = {e: k for k, e in enumerate(edges)}
    cands = [(i, j, kind, f, sum(w.get(x, 0.0) for x in f)) for i, j, kind, f in _candidates(text, edges)]
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for c in cands:
        by_end.setdefault(c[1], []).append(c)
        by_start.setdefault(c[0], []).append(c)
    touch, inf = w.get("touch", 0.0), -math.inf
    fo, fi = [0.0] + [inf] * n, [inf] * (n + 1)
    for j in range(1, n + 1):
        fo[j] = _log_add(fo[j - 1], fi[j - 1])
        for i, _, _, _, s in by_end.get(j, ()):
            fi[j] = _log_add(fi[j], s + _log_add(fo[i], fi[i] + touch))
    bo, bi = [inf] * n + [0.0], [inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        bo[i] = bi[i] = bo[i + 1]
        for _, j, _, _, s in by_start.get(i, ()):
            bo[i] = _log_add(bo[i], s + bi[j])
            bi[i] = _log_add(bi[i], s + bi[j] + touch)
    z = _log_add(fo[n], fi[n])
    grad: dict[str, float] = {}
    wanted = {(place.get(a), place.get(b), k) for k, a, b in gold}
    for i, j, kind, f, s in cands:
        p_free, p_touch = math.exp(fo[i] + s + bi[j] - z), math.exp(fi[i] + touch + s + bi[j] - z)
        d = ((i, j, kind) in wanted) - p_free - p_touch
        if abs(d) > 1e-6:
            for x in f:
                grad[x] = grad.get(x, 0.0) + d
        grad["touch"] = grad.get("touch", 0.0) - p_touch
    return grad


def _examples(n: int, seed: int = 3) -> Iterator[tuple[str, list[Span]]]:
    """Synthetic neighbourhoods: one to three entities or harmless numbers, side by side, among words."""
    r = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    word = lambda: "".join(pick("aeinorstlué") for _ in range(int(r.integers(2, 9))))
    code = lambda k, s: "".join(pick(s) for _ in range(k))

    def card(good: bool) -> str:
        while True:
            d = pick("3456") + num(14)
            d += next(str(c) for c in range(10) if luhn(d + str(c)) == good)
            g = [d[k : k + 4] for k in range(0, 16, 4)]
            return pick([d, d, d, " ".join(g), "-".join(g)])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+{pick('123456789')} ({a}) {b}-{c}"] * 2 + [f"+{pick('1234')}{num(1)} {a} {b} {c}", f"+{pick('12')}-{a}-{b}-{c}", f"+{pick('4')}{num(11)}", f"({a}) {b}-{c}", f"+{pick('34')}{num(1)}.{a}.{b}.{c}"])

    ip = lambda: ".".join(str(x) for x in r.integers(1, 256, 4))
    email = lambda: f"{word().replace('é', 'e')}{pick(['', '.', '_'])}{num(int(r.integers(0, 3)))}x@{word().replace('é', 'e')}{pick(['', num(1)])}.{pick(['example.com', 'org', 'net', 'co.uk'])}"
    harmless = [
        lambda: f"{num(1)}.{num(1)}",
        lambda: f"{num(1)}.{num(1)}.{num(1)}",
        lambda: num(int(r.integers(1, 9))),
        lambda: f"20{num(2)}-0{pick('123456789')}-1{num(1)}",
        lambda: f"1{num(1)}:{pick('012345')}{num(1)}",
        lambda: f"AKIA{code(16, 'ABCDEFGHJKLMNPQRSTUVWXYZ0123456789')}",
        lambda: f"password={code(18, '0123456789abcdef')}",
        lambda: f'"{code(40, "0123456789abcdef")}"',
        lambda: card(False),
        lambda: f"{num(3)}.{num(3)},{num(2)}",
        lambda: f"{num(int(r.integers(9, 16)))}",
        lambda: " ".join(num(int(r.integers(1, 4))) for _ in range(6)),
        lambda: f"{pick('456789')}{num(2)}.{num(2)}.{pick('3456789')}{num(2)}.{num(1)}",
        lambda: f"{word()}@{word()}",
        lambda: f"-{num(4)}-{num(4)}-{num(4)}",
    ]
    make = {"email": email, "ip": ip, "card": lambda: card(True), "phone": phone}
    for _ in range(n):
        text, gold = pick(["", f"{word()} ", f"{word()}, {word()} "]), []
        for k in range(int(r.integers(1, 4))):
            text += pick([" ", " ", " ", f" {word()} ", ", "]) if k else ""
            if r.random() < 0.62:
                kind = pick(KINDS)
                s = make[kind]()
                gold.append((kind, len(text), len(text) + len(s)))
            else:
                s = pick(harmless)()
            text += s
        yield text + pick(["", ".", f" {word()}", f" {word()}.", ","]), gold


@lru_cache(maxsize=1)
def trained_weights() -> dict[str, float]:
    """The field's weights, the same on every run; AdaGrad on the synthetic neighbourhoods."""
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    data = list(_examples(EXAMPLES))
    for _ in range(EPOCHS):
        for text, gold in data:
            for x, d in _gradient(text, gold, w).items():
                d -= DECAY * w.get(x, 0.0)
                seen[x] = seen.get(x, 1e-3) + d * d
                w[x] = w.get(x, 0.0) + RATE * d / math.sqrt(seen[x])
    return w


def neighbourhoods(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @ signs, apart from each other."""
    start = end = None
    for m in _ANCHOR.finditer(text):
        if start is not None and m.start() - end <= GAP:
            end = m.end()
            continue
        if start is not None:
            yield start, end
        start, end = m.start(), m.end()
    if start is not None:
        yield start, end


def _widened(text: str, a: int, b: int, low: int) -> tuple[int, int]:
    """To the white space around, at most AROUND characters away, and not before ``low``; a '+' or '(' belongs to it."""
    stop = max(low, a - AROUND)
    while a > stop and not text[a - 1].isspace():
        a -= 1
    stop = min(len(text), b + AROUND)
    while b < stop and not text[b].isspace():
        b += 1
    return a, b


def find_spans(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans, by start and kind; offsets in code points."""
    text = text or ""
    if not _ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    added, low = [], 0
    for a, b in neighbourhoods(text):
        a, b = _widened(text, a, b, low)
        low = b
        for kind, i, j in _decode(text[a:b], weights):
            if all(j + a <= s or i + a >= e for _, s, e in base):
                added.append((kind, a + i, a + j))
    return base, sorted(base + added, key=_order)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, overlapping ones together, replaced by its first kind in brackets."""
    out, end, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[end:a], f"[{kind.upper()}]"]
        end, k = b, k + 1
    return "".join([*out, text[end:]])


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, their digest, all spans, and how many the field added.

    Null and empty texts have none, and the digest of an empty string. One row for each row of
    ``docs``, repeated ones too; an empty table gives none; texts are read whole.
    """
    weights = trained_weights()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t, weights) for t in batch.column(1).to_pylist()]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(every) for _, every in found], pa.string()),
                    pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans replaced in ``text`` and ``n_chars``, if there is one, counted anew; null texts stay null."""
    weights, at = trained_weights(), docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns
        texts = [t if t is None else redact(t, find_spans(t, weights)[1]) for t in columns[at].to_pylist()]
        columns[at] = pa.array(texts, columns[at].type)
        if counted is not None:
            sizes = [old if t is None else len(t) for t, old in zip(texts, columns[counted].to_pylist())]
            columns[counted] = pa.array(sizes, columns[counted].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return mapped_rows(docs, clean)


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return find_personal_data(table(spark, sf_dir, "documents"))
