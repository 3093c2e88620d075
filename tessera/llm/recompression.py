"""Substring dedup by recompression: words covered by a window of ``WINDOW`` words that also starts elsewhere.

A text is a string of word symbols. Each level first replaces every maximal run of one symbol, then every
pair of a symbol of one half of the alphabet followed by one of the other; the halves are drawn anew for each
level by a bit of the symbol's hash. A symbol's name is a 64-bit hash of what it stands for, so equal runs and
pairs have one name in all tasks and no dictionary of names has to be kept or joined. What becomes of a symbol
hangs on its neighbours alone: equal windows have equal symbols inside, but for at most a run and a pair at
either end. Of each window the interior is followed through the levels, and the longest symbol inside it on
the highest level (that of least hash among equally long ones) is its anchor; windows with few words or
long runs have their anchor on a lower level, down to the words themselves.

Windows next to each other with one anchor make a piece. Then Spark's rounds: anchors (names) are counted
over all texts, and one that occurs once reveals that its windows do not repeat; pieces of the other anchors
are compared by their words, and those that occur twice are repeats as a whole; of the different pieces of one
anchor every window is compared.

Pieces and windows are known by their anchor's name and a 64-bit polynomial hash of their words, at most
69 words long, rows by two 64-bit hashes of doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import bound_batches, small_side, table, written
from tessera.llm.repeats import _keyed, _merged

WINDOW = 35
#: Levels of runs and pairs: symbols of the last stand for about three words each, the longest in a window for more.
LEVELS = 4
#: Texts that are held as Python objects at a time.
SLICE = 256
_U = np.uint64


class Symbols:
    """The symbols of many texts on one level: name, first word, word after the last, and whether a text begins here."""

    def __init__(self, name: np.ndarray, first: np.ndarray, after: np.ndarray, begins: np.ndarray):
        self.name, self.first, self.after, self.begins = name, first, after, begins

    def runs(self) -> tuple[Symbols, np.ndarray]:
        """Maximal runs within a text as symbols, and the run of each symbol."""
        starts = np.flatnonzero(np.r_[True, self.name[1:] != self.name[:-1]] | self.begins)
        ends = np.r_[starts[1:], len(self.name)]
        length, name = ends - starts, self.name[starts]
        name = np.where(length == 1, name, tb.mix(name ^ tb.mix(length.astype(_U), 81), 82))
        of = np.zeros(len(self.name), np.int64)
        of[starts[1:]] = 1
        return Symbols(name, self.first[starts], self.after[ends - 1], self.begins[starts]), np.cumsum(of)

    def right_half(self, level: int) -> np.ndarray:
        """Whether a symbol can only end a pair; the others can only begin one."""
        return (tb.mix(self.name, 200 + level) >> _U(63)).astype(bool)

    def pairs(self, right: np.ndarray) -> tuple[Symbols, np.ndarray]:
        """Pairs within a text as symbols, and the symbol that each one goes into."""
        paired = np.r_[~right[:-1] & right[1:] & ~self.begins[1:], False]
        second = np.r_[False, paired[:-1]]
        keep = np.flatnonzero(~second)
        both = tb.mix(self.name[keep] * _U(0x9E3779B97F4A7C15) + tb.mix(self.name[np.minimum(keep + 1, len(second) - 1)], 83), 84)
        name = np.where(paired[keep], both, self.name[keep])
        return Symbols(name, self.first[keep], self.after[keep + paired[keep]], self.begins[keep]), np.cumsum(~second) - 1


def _longest(symbols: Symbols, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each range of symbols the longest; among equally long ones that of least hash, then the first."""
    length = np.minimum(symbols.after - symbols.first, 63).astype(_U)
    rank = (tb.mix(symbols.name, 85) >> _U(6)) | ((_U(63) - length) << _U(58))
    best, least = low.copy(), rank[low]
    live, step = np.flatnonzero(high - low > 1), 1
    while len(live):
        at = low[live] + step
        better = rank[at] < least[live]
        best[live[better]], least[live[better]] = at[better], rank[at[better]]
        step += 1
        live = live[high[live] - low[live] > step]
    return best


def anchors(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each window that lies inside one text, the name of its anchor, and the anchor's first word.

    ``words``: hashes of the words of all texts, ``owner``: n + 1 offsets of the texts' words.
    """
    n = len(words)
    begins = np.zeros(n + 1, bool)
    begins[owner[:-1]] = True
    ends = np.repeat(owner[1:], np.diff(owner))
    window = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    name, place = np.zeros(len(window), _U), np.zeros(len(window), np.int64)
    symbols = Symbols(words, np.arange(n), np.arange(1, n + 1), begins[:-1])
    low, high, live = window.copy(), window + WINDOW, np.arange(len(window))

    def settle(which: np.ndarray) -> None:
        """The anchors of these windows are on this level."""
        best = _longest(symbols, low[which], high[which])
        name[live[which]], place[live[which]] = symbols.name[best], symbols.first[best]

    for level in range(1, LEVELS + 1):
        if not len(live):
            break
        runs, of = symbols.runs()
        right = runs.right_half(level)
        # the runs at both ends may go on outside of the window
        a, b = of[low] + 1, of[high - 1]
        inside = a < b
        a, b = np.where(inside, a, 0), np.where(inside, b, 1)
        # the first may end a pair that begins outside, the last may begin one that ends there
        a, b = a + right[a], b - ~right[b - 1]
        inside &= a < b
        if not inside.all():
            settle(np.flatnonzero(~inside))
        symbols, of = runs.pairs(right)
        live = live[inside]
        low, high = of[a[inside]], of[b[inside] - 1] + 1
    if len(live):
        settle(np.arange(len(live)))
    return window, name, place


def word_sums(words: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums for :func:`tessera.llm.textbytes.substring_hash` over words instead of bytes."""
    out = np.zeros(len(words) + 1, _U)
    np.cumsum(words * tb.powers(len(words) + 1)[0][: len(words)], out=out[1:])
    return out


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, owner = tb.words(data, at)
    return tb.word_hashes(data, begin, end), owner


def pieces(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each piece: text index, first window, number of windows, anchor, hash of its words."""
    window, name, place = anchors(words, owner)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (window[1:] != window[:-1] + 1)])
    count, begin = np.diff(np.r_[first, len(window)]), window[first]
    text = np.searchsorted(owner, begin, "right") - 1
    whole = tb.mix(tb.substring_hash(word_sums(words), begin, begin + count + WINDOW - 1), 62) ^ tb.mix(count.astype(_U), 63)
    return text, begin - owner[text], count, name[first].view(np.int64), whole.view(np.int64)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, data, at in tb.chunks(batch.column(2)):
            text, first, count, anchor, piece = pieces(*_words(data, at))
            rows = pa.array(text + i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int32()), pa.array(count.astype(np.int16)), pa.array(anchor), pa.array(piece)],
                names=["id", "mark", "first", "windows", "anchor", "piece"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the wanted pieces of each text: anchor and place of the anchor in it, hash of its words, row, first word, alone."""
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        for i, j, data, at in tb.chunks(batch.column(2)):
            words, owner = _words(data, at)
            sums, lists = word_sums(words), batch.column(3).slice(i, j - i)
            wanted, size = lists.flatten(), lists.value_lengths().to_numpy()
            of = np.repeat(np.arange(j - i), size)
            part = lambda name: wanted.field(name).to_numpy(zero_copy_only=False)
            first, count = part("first").astype(np.int64), part("windows").astype(np.int64)
            piece = np.repeat(np.arange(len(of)), count)
            step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
            a = first[piece] + step
            begin = owner[of[piece]] + a
            window = tb.mix(tb.substring_hash(sums, begin, begin + WINDOW), 64).view(np.int64)
            row = pa.array(of[piece] + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part("anchor")[piece]), pa.array(window), batch.column(0).take(row), batch.column(1).take(row), pa.array(a, pa.int32()), pa.array(part("alone")[piece])],
                names=["anchor", "window", "id", "mark", "a", "alone"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, mark, a, b: ranges of words (end exclusive) of repeating windows, overlapping and repeated ones too."""
    bound_batches(docs.sparkSession)
    texts = _keyed(docs).select("id", "mark", "text").filter(F.octet_length("text") >= 2 * WINDOW - 1)
    found = texts.mapInArrow(_piece_rows, "id long, mark long, first int, windows short, anchor long, piece long")
    # tables of their own, so that the joins deal both sides anew and a hot anchor's rows can be split
    common = written(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    rows = written(found.join(common, "anchor"))
    kinds = written(rows.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "first", "windows")).alias("one")))
    copied = rows.join(kinds.filter("n > 1").select("anchor", "piece"), ["anchor", "piece"]).select(
        "id", "mark", F.col("first").alias("a"), (F.col("first") + F.col("windows") + (WINDOW - 1)).alias("b")
    )
    # anchors with different pieces, one of which at least is not settled
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("pieces"), F.min("n").alias("least")).filter("pieces > 1 and least = 1").select("anchor")
    wanted = written(
        kinds.join(mixed, "anchor")
        .groupBy(F.col("one.id").alias("id"), F.col("one.mark").alias("mark"))
        .agg(F.collect_list(F.struct("anchor", F.col("one.first").alias("first"), F.col("one.windows").cast("int").alias("windows"), (F.col("n") == 1).alias("alone"))).alias("wanted"))
    )
    keys = small_side(wanted.select("id", "mark"), wanted.count())
    held = texts.join(keys, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]).join(wanted, ["id", "mark"])
    windows = written(held.select("id", "mark", "text", "wanted").mapInArrow(_window_rows, "anchor long, window long, id long, mark long, a int, alone boolean"))
    again = windows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).filter("n > 1 and alone").select("anchor", "window")
    return copied.unionByName(windows.filter("alone").join(again, ["anchor", "window"]).select("id", "mark", "a", (F.col("a") + WINDOW).alias("b")))


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        kept, counts = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = text.encode().split()  # at ASCII white space
            n = len(own)
            for a, b in reversed(_merged(spans or [])):
                del own[a:b]
            kept.append(b" ".join(own))
            counts.append((n, n - len(own)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(2)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the remaining words, joined by one space) of each row.

    Null texts have no words; texts of fewer than ``WINDOW`` words keep all. A repeated row is a copy
    elsewhere, so both lose what is ``WINDOW`` words or longer; in a run of one word that is longer than a window every
    word goes. An empty table gives no rows.
    """
    spans = repeated_spans(docs).distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = _keyed(docs).join(spans, ["id", "mark"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op13_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the words of every document without its repeated windows."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE_RECOMPRESSION = """
WITH d AS (
  SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT nr, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), s AS (
  SELECT d.nr, t.i, md5(array_to_string(d.w[t.i : t.i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(d.w) - 33)) AS i) t
), r AS (
  SELECT nr, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1
), c AS (
  SELECT p.nr, p.i, word, max(r.i) OVER (PARTITION BY p.nr ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NULL AS kept FROM p LEFT JOIN r ON r.nr = p.nr AND r.i = p.i
), k AS (
  SELECT nr, count(*) FILTER (WHERE NOT kept) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE kept) AS text FROM c GROUP BY nr
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.nr = d.nr
"""
