"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here and rebuilt: normaliser (character map, dummy prefix, space as
metaspace), BPE merges or unigram scores, byte fallback and decoder. Texts are encoded in batches, with as
many threads as a task has cores; where no piece crosses a word's border, by their different words. Each
string that is encoded is also given to the sentencepiece library to verify parity, for every model.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, table

MODEL_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL_FILE = "piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What the library decodes an unknown piece to.
UNKNOWN_SURFACE = " \u2047 "
#: Words that a task remembers (twice, at most), and texts that it works on at a time.
REMEMBERED, TEXTS = 250_000, 256
#: Words that are joined to one string.
JOINED = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < n:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = varint() if size is None else size
        yield key >> 3, data[i : i + size]
        i += size


@dataclass
class ModelSpec:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True


def parse_model(raw: bytes) -> ModelSpec:
    spec = ModelSpec()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            spec.pieces.append(piece)
            spec.scores.append(score)
            spec.kinds.append(kind)
        elif number == 2:
            trainer = dict(_fields(value))
            spec.model_type = trainer.get(3, UNIGRAM)
            spec.byte_fallback = bool(trainer.get(35, 0))
            spec.unk_id = trainer.get(40, 0)
        elif number == 3:
            norm = dict(_fields(value))
            spec.charsmap = norm.get(2, b"")
            spec.add_dummy_prefix = bool(norm.get(3, 1))
            spec.remove_extra_whitespaces = bool(norm.get(4, 1))
    return spec


def _merges(spec: ModelSpec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best scores first; among the pairs of one piece by their ids."""
    ids = {p: i for i, p in enumerate(spec.pieces)}
    made = []
    for i in sorted((i for i, p in enumerate(spec.pieces) if spec.kinds[i] == NORMAL and len(p) > 1), key=lambda i: (-spec.scores[i], i)):
        pairs = [(spec.pieces[i][:k], spec.pieces[i][k:]) for k in range(1, len(spec.pieces[i]))]
        made += sorted(((a, b) for a, b in pairs if a in ids and b in ids), key=lambda p: (ids[p[0]], ids[p[1]]))
    return made


def build(spec: ModelSpec):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, p in enumerate(spec.pieces)}
    if spec.model_type == BPE:
        model = models.BPE(vocab=vocab, merges=_merges(spec), unk_token=spec.pieces[spec.unk_id], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        model = models.Unigram(list(zip(spec.pieces, spec.scores)), unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
    out = Tokenizer(model)
    user = [AddedToken(p, normalized=False) for p, k in zip(spec.pieces, spec.kinds) if k == USER_DEFINED]
    if user:
        out.add_tokens(user)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra_whitespaces:
        from tokenizers import Regex

        # spaces alone; the library's strip would take newlines too
        steps += [normalizers.Replace(Regex(rx), new) for rx, new in ((" {2,}", " "), (r"\A ", ""), (r" \z", ""))]
    steps += [normalizers.Prepend(MARK)] if spec.add_dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)]
    out.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


#: Parts of a normalised text in which lines and spaces don't pair up one by one.
_PART = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*")


class Codec:
    """Encodes and decodes texts; remembers the words it has met.

    A word is what stands between two spaces, with its metaspace, or between a newline and a space. Where
    no piece has a metaspace after another character and newlines are only bytes, no piece crosses a word's
    border (``by_words``): words are then encoded once while they are remembered, many joined by newlines in
    one string. Other models encode whole texts.
    """

    def __init__(self, raw: bytes, check: bool = True, threads: int = 1):
        # a task has few cores; the libraries would start a thread for each of the machine's
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import normalizers

        self.threads = threads
        self.spec = parse_model(raw)
        self.tokenizer = build(self.spec)
        pieces = [p for p, k in zip(self.spec.pieces, self.spec.kinds) if k in (NORMAL, USER_DEFINED)]
        newlines = [i for i, (p, k) in enumerate(zip(self.spec.pieces, self.spec.kinds)) if k == BYTE and p == "<0x0A>"]
        self.by_words = (
            not self.spec.charsmap
            and not self.spec.remove_extra_whitespaces
            and self.spec.add_dummy_prefix
            and self.spec.byte_fallback
            and len(newlines) == 1
            and USER_DEFINED not in self.spec.kinds
            and not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        )
        if self.by_words:
            self.newline = newlines[0]
            self.tokenizer.normalizer = normalizers.Sequence([])  # words come normalised
        #: Ids of the words that were met lately, and of those before them; words on which the libraries differ.
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.peer = None
        if check:
            from sentencepiece import SentencePieceProcessor

            self.peer = SentencePieceProcessor(model_proto=raw)
        surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_SURFACE.encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(self.spec.pieces, self.spec.kinds)
        ]
        self._pool = np.frombuffer(b"".join(surface), np.uint8)
        self._sizes = np.array([len(x) for x in surface], np.int64)
        self._marked = [k in (NORMAL, USER_DEFINED) and p.startswith(MARK) for p, k in zip(self.spec.pieces, self.spec.kinds)]
        self._begin = np.cumsum(self._sizes) - self._sizes

    def _words(self, text: str) -> list[str]:
        """The words of a text: after a newline with it, else without the one metaspace they begin with."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return [p if p[0] == "\n" else p[1:] for p in _PART.findall(MARK + text.replace(" ", MARK))]
        return text.replace("\n", " \n").split(" ")

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not remembered, ``JOINED`` in one string, and compare with the peer."""
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        strings = ["".join([w if w[:1] == "\n" else f"\n{MARK}{w}" for w in g]) for g in groups]
        own = [np.array(enc.ids, "<i4") for enc in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        # the library puts one metaspace before the first newline
        theirs = [np.array(ids[1:], "<i4") for ids in self.peer.encode([s.replace(MARK, " ") for s in strings], num_threads=self.threads)] if self.peer else own
        for g, a, b in zip(groups, own, theirs):
            at = np.flatnonzero(a == self.newline)
            raw, ends = a.tobytes(), np.r_[at[1:], len(a)] * 4
            found = [raw[i if w[:1] == "\n" else i + 4 : j] for w, i, j in zip(g, (at * 4).tolist(), ends.tolist())]
            self.ids.update(zip(g, found))
            if a is not b and not np.array_equal(a, b):
                self.odd.update(w for w, ids in zip(g, found) if self._peer_ids(w) != ids)

    def _peer_ids(self, word: str) -> bytes:
        if word[:1] == "\n":
            return np.array(self.peer.encode(word)[1:], "<i4").tobytes()
        return np.array(self.peer.encode("\n " + word.replace(MARK, " "))[2:], "<i4").tobytes()

    def _encode_by_words(self, texts: list[str]) -> list[tuple[np.ndarray, bool | None]]:
        split = [self._words(t) for t in texts]
        if len(self.ids) > REMEMBERED:
            self.older, self.ids = self.ids, {}
        new = set().union(*split) - self.ids.keys()
        known = [w for w in new if w in self.older]
        self.ids.update((w, self.older[w]) for w in known)
        new.difference_update(known)
        if new:
            self._learn(list(new))
        out = []
        for words in split:
            ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), "<i4")
            out.append((ids, None if self.peer is None else not self.odd or self.odd.isdisjoint(words)))
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool | None]]:
        """Ids of each text, and whether the sentencepiece library agrees (None if it is not asked)."""
        out: list[tuple[np.ndarray, bool | None]] = []
        for k in range(0, len(texts), TEXTS):
            some = texts[k : k + TEXTS]
            if self.by_words:
                out += self._encode_by_words(some)
                continue
            own = [enc.ids if t else [] for t, enc in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))]
            theirs = self.peer.encode(some, num_threads=self.threads) if self.peer else [None] * len(some)
            out += [(np.array(a, "<i4"), None if b is None else a == b) for a, b in zip(own, theirs)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The pieces' texts in a row; bytes that make no character are replaced."""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self._begin[ids] - (ends - sizes), sizes)
        text = self._pool[at].tobytes().decode("utf-8", "replace")
        first = np.flatnonzero(sizes)[:1]
        return text[1:] if self.spec.add_dummy_prefix and len(first) and self._marked[ids[first[0]]] else text


@lru_cache(maxsize=2)
def _codec(raw: bytes, threads: int) -> Codec:
    return Codec(raw, threads=threads)


def _task_cores(spark: SparkSession) -> int:
    """Cores that a task has to itself: the libraries' threads."""
    return int(spark.sparkContext.getConf().get("spark.task.cpus", "1"))


def model_bytes(path: str | None = None) -> bytes:
    """The model file's bytes (half a MB), read where the driver runs and sent with the tasks."""
    with open(path or os.path.join(MODEL_DIR, MODEL_FILE), "rb") as f:
        return f.read()


_TOKENS = "doc_id long, tokens array<int>, decoded string, parity boolean"


def encode_documents(docs: DataFrame, raw: bytes) -> DataFrame:
    """doc_id, tokens, decoded, parity of each row: the ids, the text that they decode to, and whether the
    sentencepiece library gives the same ids for the text or for each of its words.

    Null and empty texts have no tokens. The decoded text is the text with metaspaces as spaces. Repeated
    rows get one row each; an empty table gives none; a long text is one row whatever its length.
    """
    bound_batches(docs.sparkSession)
    shared, threads = docs.sparkSession.sparkContext.broadcast(raw), _task_cores(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, threads)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                done = codec.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *(len(ids) for ids, _ in done)], dtype=np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids for ids, _ in done]) if done else [], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), tokens, pa.array([codec.decode(ids) for ids, _ in done], pa.string()), pa.array([ok for _, ok in done], pa.bool_())],
                    names=["doc_id", "tokens", "decoded", "parity"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENS)


def encoded_digests(docs: DataFrame, raw: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), round_trip, parity of each row."""
    bound_batches(docs.sparkSession)
    shared, threads = docs.sparkSession.sparkContext.broadcast(raw), _task_cores(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, threads)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                done = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(ids) for ids, _ in done], pa.int64()),
                        pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids, _ in done], pa.string()),
                        pa.array([codec.decode(ids) == t.replace(MARK, " ") for (ids, _), t in zip(done, texts)], pa.bool_()),
                        pa.array([ok for _, ok in done], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encoded_digests(table(spark, sf_dir, "documents"), model_bytes())
