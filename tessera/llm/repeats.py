"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Equal strings of ``LENGTH`` bytes hold the same minimiser, the k-gram of least hash, so a window is
known by its minimiser's place, and windows with the same minimiser next to each other make a piece.
Anchors (minimiser k-grams) that occur once in the corpus cannot be in a repeat; pieces that occur
twice are repeats as a whole. Only the different pieces of one anchor are left: they go to shards by
anchor, where suffix arrays are built by induced sorting and permuted common prefixes of ``LENGTH`` or
more mark the windows that repeat. An anchor with more than ``SHARD_PIECES`` different pieces is not held
in one shard: its windows are grouped by their bytes' hash instead.

Anchors and windows of one anchor are known by 64-bit polynomial hashes each, pieces by their anchor's and
their own (128 bits); at most 352 bytes long, they are below the lengths at which such hashes have
systematic clashes. Rows are known by two 64-bit hashes of doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import bound_batches, small_side, table, utf8, written
from tessera.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 200, 48
_WINDOW = LENGTH - GRAM + 1
#: Windows by the place of their anchor, in classes that share a core.
CLASS = 20
#: Different pieces of one anchor that a shard takes; bytes of one suffix array.
SHARD_PIECES, SHARD_BYTES = 2048, 1 << 19
#: Texts that are held as Python objects at a time.
SLICE = 256
_U = np.uint64


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if width > done else v


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each piece: text index, first window, number of windows, place of the anchor after it, anchor hash, piece hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, none
    sums = tb.prefix_sums(data)
    starts = np.arange(n - GRAM + 1)
    grams = tb.mix(tb.substring_hash(sums, starts, starts + GRAM), 61)
    keyed = (grams & _U(0xFFFFFFFF00000000)) | starts.astype(_U)
    place = (_sliding_min(keyed, _WINDOW) & _U(0xFFFFFFFF)).astype(np.int64)
    # windows that lie inside one text
    change = np.zeros(n + 1, np.int64)
    long = np.diff(at) >= LENGTH
    np.add.at(change, at[:-1][long], 1)
    np.add.at(change, at[1:][long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(change[:-1])[: len(place)] > 0)
    if not len(window):
        return none, none, none, none, none, none
    where = place[window]
    first = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (window[1:] != window[:-1] + 1)])
    count = np.diff(np.r_[first, len(window)])
    begin = window[first]
    text = np.searchsorted(at, begin, "right") - 1
    whole = tb.mix(tb.substring_hash(sums, begin, begin + count + LENGTH - 1), 62) ^ tb.mix(count.astype(_U), 63)
    return text, begin - at[text], count, where[first] - begin, grams[where[first]].view(np.int64), whole.view(np.int64)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, data, at in tb.chunks(batch.column(2)):
            text, first, count, offset, anchor, piece = pieces(data, at)
            rows = pa.array(text + i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int32()), pa.array(count.astype(np.int16)), pa.array(offset.astype(np.int16)), pa.array(anchor), pa.array(piece)],
                names=["id", "mark", "first", "windows", "offset", "anchor", "piece"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    """id, mark, doc_id, text: two 64-bit hashes that stand for a row, one of doc_id and text and one of the text alone.

    Rows that agree in both are copies: the same doc_id (or none) with the same text, which keep the same bytes.
    """
    doc_id, text = F.col("doc_id").cast("long"), utf8()
    return docs.select(
        F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), text).alias("id"), F.xxhash64(F.lit("text"), text, F.octet_length(text)).alias("mark"), doc_id.alias("doc_id"), text.alias("text")
    )


def _possible(group: list[tuple]) -> Iterator[tuple]:
    """The stretches of an anchor's pieces that may repeat: id, mark, first window, alone, windows, bytes.

    Windows whose anchor lies ``q * CLASS`` to ``q * CLASS + CLASS - 1`` bytes after their start have a core in
    common; a window can only repeat if another piece has the same core.
    """
    seen: dict[tuple[int, bytes], int] = {}
    cores = []
    for *_, count, offset, raw in group:
        own = []
        for q in range((offset - count + 1) // CLASS, offset // CLASS + 1):
            low = q * CLASS
            own.append((q, raw[offset - low : offset - min(low + CLASS, _WINDOW) + 1 + LENGTH]))
        cores.append(own)
        for k in own:
            seen[k] = seen.get(k, 0) + 1
    for (key, mark, first, alone, count, offset, raw), own in zip(group, cores):
        shared = [q for q, core in own if seen[q, core] > 1]
        k = 0
        while k < len(shared):
            j = k
            while j + 1 < len(shared) and shared[j + 1] == shared[j] + 1:
                j += 1
            a, b = max(0, offset - shared[j] * CLASS - CLASS + 1), min(count - 1, offset - shared[k] * CLASS)
            yield key, mark, first + a, alone, b - a + 1, raw[a : b + LENGTH]
            k = j + 1


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeating windows of the pieces that occur once; pieces come ordered by anchor."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def settle() -> pa.RecordBatch:
        ids, marks, firsts, alone, counts, texts = (list(x) for x in zip(*held))
        lengths = np.array([len(t) for t in texts])
        symbols = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int64) + 2
        begin = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        symbols[begin + lengths] = 1
        symbols = np.r_[symbols, 0]
        order = suffix_array(symbols, 258)
        shared = permuted_common_prefixes(symbols, order, 1)
        repeats = shared >= LENGTH
        repeats[order[:-1][shared[order[1:]] >= LENGTH]] = True
        out: list[tuple] = []
        for k in np.flatnonzero(np.array(alone)):
            hit = np.flatnonzero(np.diff(np.r_[False, repeats[begin[k] : begin[k] + counts[k]], False].astype(np.int8)))
            out += [(ids[k], marks[k], firsts[k] + int(a), firsts[k] + int(b) - 1 + LENGTH) for a, b in zip(hit[::2], hit[1::2])]
        cols = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "mark", "a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if group and row[0] != group[0][0]:
                for piece in _possible([g[1:] for g in group]):
                    held.append(piece)
                    size += len(piece[5]) + 1
                group = []
                if size > SHARD_BYTES:
                    yield settle()
                    held, size = [], 0
            group.append(row)
    held += _possible([g[1:] for g in group])
    if held:
        yield settle()


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each text."""
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        out: list[tuple] = []
        for key, mark, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = text.encode()
            out += [(w["anchor"], key, mark, w["first"], w["alone"], w["windows"], w["offset"], raw[w["first"] : w["first"] + w["windows"] + LENGTH - 1]) for w in wanted]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        cols = list(zip(*out)) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "id", "mark", "first", "alone", "windows", "offset", "bytes"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the pieces by the hash of its bytes."""
    for batch in batches:
        for row in range(batch.num_rows):
            anchor, key, mark, first, alone, count, _, raw = (batch.column(k)[row].as_py() for k in range(8))
            sums, at = tb.prefix_sums(np.frombuffer(raw, np.uint8)), np.arange(count)
            h = tb.mix(tb.substring_hash(sums, at, at + LENGTH), 64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([anchor] * count), pa.array(h), pa.array([key] * count), pa.array([mark] * count, pa.int64()), pa.array(first + at, pa.int32()), pa.array([alone] * count)],
                names=["anchor", "window", "id", "mark", "a", "alone"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, mark, a, b: byte ranges (end exclusive) of repeating windows, overlapping and repeated ones too."""
    bound_batches(docs.sparkSession)
    found = _keyed(docs).filter(F.octet_length("text") >= LENGTH).select("id", "mark", "text").mapInArrow(_piece_rows, "id long, mark long, first int, windows short, offset short, anchor long, piece long")
    # a table of its own, so that the join below deals both sides anew and a hot anchor's rows can be split
    common = written(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    rows = written(found.join(common, "anchor"))
    kinds = written(
        rows.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "first", "windows", "offset")).alias("one"))
    )
    copied = rows.join(kinds.filter("n > 1").select("anchor", "piece"), ["anchor", "piece"]).select(
        "id", "mark", F.col("first").alias("a"), (F.col("first") + F.col("windows") + (LENGTH - 1)).alias("b")
    )
    # anchors with different pieces, one of which at least is not settled
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("pieces"), F.min("n").alias("least")).filter("pieces > 1 and least = 1").select("anchor", "pieces")
    wanted = written(
        kinds.join(mixed, "anchor")
        .groupBy(F.col("one.id").alias("id"), F.col("one.mark").alias("mark"))
        .agg(
            F.collect_list(
                F.struct("anchor", F.col("one.first").alias("first"), (F.col("n") == 1).alias("alone"), F.col("one.windows").cast("int").alias("windows"), F.col("one.offset").cast("int").alias("offset"), (F.col("pieces") > SHARD_PIECES).alias("hot"))
            ).alias("wanted")
        )
    )
    keys = small_side(wanted.select("id", "mark"), wanted.count())
    texts = _keyed(docs).select("id", "mark", "text").join(keys, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]).join(wanted, ["id", "mark"])
    fetched = lambda hot: texts.select("id", "mark", "text", F.filter("wanted", lambda w: w["hot"] == hot).alias("wanted")).filter(F.size("wanted") > 0).mapInArrow(
        _fetched, "anchor long, id long, mark long, first int, alone boolean, windows int, offset int, bytes binary"
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = fetched(False).repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_shard_rows, "id long, mark long, a int, b int")
    out = copied.unionByName(sharded)
    if not mixed.filter(F.col("pieces") > SHARD_PIECES).isEmpty():
        windows = written(fetched(True).mapInArrow(_window_rows, "anchor long, window long, id long, mark long, a int, alone boolean"))
        again = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window")
        out = out.unionByName(windows.filter("alone").join(again, ["anchor", "window"]).select("id", "mark", "a", (F.col("a") + LENGTH).alias("b")))
    return out


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        kept, runs = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw, parts, end = text.encode(), [], 0
            merged = _merged(spans or [])
            for a, b in merged:
                parts.append(raw[end:a])
                end = b
            parts.append(raw[end:])
            kept.append(b"".join(parts))
            runs.append((len(raw), sum(b - a for a, b in merged), len(merged)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array([r[k] for r in runs], pa.int64()) for k in range(3)),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of each row.

    Null texts are empty; texts shorter than ``LENGTH`` bytes keep all. A repeated row is a copy
    elsewhere, so both lose what is ``LENGTH`` bytes or longer. An empty table gives no rows. What is
    kept may end inside a character, as the cuts are between bytes.
    """
    spans = repeated_spans(docs).distinct().groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = _keyed(docs).join(spans, ["id", "mark"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
