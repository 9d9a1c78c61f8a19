"""Byte-level BPE encoding and decoding.

Greedy merging by rank is reproduced without merging: a piece is encoded from left to right with the
longest token that matches, and a choice is kept only if it is compatible with the token before it,
that is, if BPE applied to the two tokens' bytes gives just these two. Where no token fits, the last
one is taken back and its next shorter prefix tried; a bit for each position that has failed keeps
this linear. Compatibility of two tokens is memoised, and so are whole pieces.

An Aho-Corasick automaton, over the bytes read as Latin-1 characters, gives the longest matches of a
piece in one pass; the search starts at the first two of them that are not compatible.

Defined results: a null text counts as empty and has no tokens; text is split by the given pattern
only, and no special tokens exist. Ranks must come from BPE training (each token of two or more
bytes is the merge of two others), as in the public rank files. Only the named columns are read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean, small_batches
from .words import sliced

#: Pieces and pairs whose results a task keeps at most, of each.
MOST_KEPT = 320_000

#: Text bytes whose parts are told apart, and then encoded once, at a time. Decoding them takes some twenty times as many.
SLICE_BYTES = 2 << 20

#: Token ids that are decoded at a time; a row with more is a slice of its own.
SLICE_IDS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base64 and rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class _Recent:
    """Results by key, in two generations: when the younger one is full, the older one goes and what
    is still asked for comes back from it."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= MOST_KEPT // 2:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def clear(self) -> None:
        self.young, self.old = {}, {}


class Encoder:
    """Encodes and decodes by the ranks of byte sequences, as merging by rank would."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.names = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.most = max(self.lengths.values())
        self.automaton = ahocorasick.Automaton()
        for name, rank in self.names.items():
            self.automaton.add_word(name, rank)
        self.automaton.make_automaton()
        #: The longest token that starts each prefix of tokens met so far.
        self.prefixes: dict[str, int] = {}
        #: The longest proper prefix of a token that is a token itself.
        self.shorter = {rank: next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), None) for token, rank in ranks.items()}
        #: Of pairs, as a * 2 ** 32 + b: the token they merge to; whether they are compatible.
        self.merged: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}
        #: Ids of pieces, as bytes of 32-bit numbers.
        self.encoded = _Recent()
        for rank in sorted(self.tokens):
            self._learn(rank)
        self.forget()

    def forget(self) -> None:
        """Drop what the texts so far have left behind."""
        self.known.clear()
        self.encoded.clear()

    def _learn(self, rank: int) -> None:
        """Which two tokens merge into this one: the split whose sides stand when all merges before it are done."""
        token = self.tokens[rank]
        for k in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank and self._stands(a, b):
                self.merged[a << 32 | b] = rank
                self.parts[rank] = (a, b)
                return

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of the two tokens gives these two tokens."""
        found = self.known.get(a << 32 | b)
        if found is None:
            if len(self.known) >= MOST_KEPT:
                self.known.clear()
            found = self.known[a << 32 | b] = self._stands(a, b)
        return found

    def _stands(self, a: int, b: int) -> bool:
        # undo merges of the two tokens, latest first; no merge across the border may come before one undone
        limit = len(self.tokens) + 1
        while True:
            if self.merged.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                left, right = self.parts.get(a), None
                if left is None:
                    right = self.parts.get(b)
            else:
                left, right = None, self.parts.get(b)
                if right is None:
                    left = self.parts.get(a)
            if left is not None:
                limit, a = a, left[1]
            elif right is not None:
                limit, b = b + 1, right[0]
            else:
                return True

    def _longest(self, piece: str, at: int) -> int:
        """The longest token that starts at a place."""
        name = piece[at : at + self.automaton.longest_prefix(piece[at : at + self.most])]
        token = self.prefixes.get(name)
        if token is None:
            token = self.prefixes[name] = next(self.names[name[:k]] for k in range(len(name), 0, -1) if name[:k] in self.names)
        return token

    def _encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        text, size = piece.decode("latin-1"), len(piece)
        lengths, shorter, known, stands = self.lengths, self.shorter, self.known, self.compatible
        out, at, last = [], 0, -1
        for _, token in self.automaton.iter_long(text):
            if last >= 0:
                fits = known.get(last << 32 | token)
                if fits is None:
                    fits = stands(last, token)
                if not fits:
                    break
            out.append(token)
            at, last = at + lengths[token], token
        if at == size:
            return out
        longest, failed = self._longest, None
        token = longest(text, at)
        while True:
            if token is None:
                if failed is None:
                    failed = bytearray(size + 1)
                failed[at] = 1
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
                token = shorter[token]
                continue
            end = at + lengths[token]
            if failed is None or not failed[end]:
                fits = True if last < 0 else known.get(last << 32 | token)
                if fits is None:
                    fits = stands(last, token)
                if fits:
                    out.append(token)
                    if end == size:
                        return out
                    at, last = end, token
                    token = longest(text, at)
                    continue
            token = shorter[token]

    def encoded_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        out, kept = [], self.encoded
        for piece in self.pieces.findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = array("i", self._encode(piece.encode())).tobytes()
                if len(piece) < 60:
                    kept.put(piece, ids)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encoded_bytes(text)).tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: Bytes that a character other than white space can start with, for certain.
_INK = np.array([0x21 <= b <= 0x7E or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each space that a character other than white space follows, and the
    texts' offsets in these units.

    The pattern always cuts there, and what it does before doesn't depend on what comes after, so
    equal units have equal tokens wherever they stand.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8).copy()
    raw = b"" if data is None else bytes(memoryview(data)[at[0] : at[-1]])
    at -= at[0]
    chars = np.frombuffer(raw, np.uint8)
    cut = np.zeros(len(chars), bool)
    cut[:-1] = (chars[:-1] == 32) & _INK[chars[1:]]
    cut[at[1:][at[1:] > 0] - 1] = False
    cut[at[:-1][at[:-1] < len(chars)]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(chars))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]), np.searchsorted(starts, at)


def _gathered(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values`` one after another, and their bounds."""
    lengths = np.diff(bounds)[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    at = np.repeat(bounds[which] - out[:-1], lengths)
    at += np.arange(out[-1])
    return values[at], out


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(shared, path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(shared.value, pattern)
    return _encoders[path, pattern]


class _Decoder:
    """Token ids to bytes, many at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bounds = np.zeros(max(ranks.values(), default=-1) + 2, np.int64)
        for token, rank in ranks.items():
            self.bounds[rank + 1] = len(token)
        np.cumsum(self.bounds, out=self.bounds)
        self.chars = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; null for null."""
        chars, ends = _gathered(self.chars, self.bounds, lists.flatten().to_numpy().astype(np.int64))
        at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[at]), pa.py_buffer(chars)]).cast(pa.binary())
        return pc.if_else(lists.is_valid(), made, pa.scalar(None, pa.binary()))


def encoded(documents: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """Each document's ``doc_id`` and ``ids``, the tokens of its whole text.

    With ``decode`` also ``decoded``, the bytes that the ids stand for, without a second way to Python.
    ``pattern`` must, as that of the public rank files does, end a match before each space that a
    character other than white space follows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared, ranks_path, pattern), _Decoder(shared.value) if decode else None
        try:
            for batch in batches:
                for part in sliced(batch, most=SLICE_BYTES):
                    units, owners = _units(part.column("text"))
                    coded = units.dictionary_encode()
                    each = list(map(encoder.encoded_bytes, coded.dictionary.cast(pa.large_string()).to_pylist()))
                    bounds = np.zeros(len(each) + 1, np.int64)
                    np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) // 4, out=bounds[1:])
                    ids, ends = _gathered(np.frombuffer(b"".join(each), np.int32), bounds, np.asarray(coded.indices).astype(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(ends[owners].astype(np.int32)), pa.array(ids))
                    if decoder is None:
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])
                    else:
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoder.texts(lists)], ["doc_id", "ids", "decoded"])
        finally:
            encoder.forget()

    more = ", decoded binary" if decode else ""
    return docs.mapInArrow(lean(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>{more}")


def decoded(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of each row's token ids (null for null)."""
    small_batches(tokens.sparkSession)
    rows = tokens.withColumn("decoded", F.lit(None).cast("binary"))
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(shared.value)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(ids)), 0))
            turn = np.cumsum(sizes) // SLICE_IDS
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                yield part.set_column(part.schema.get_field_index("decoded"), "decoded", decoder.texts(part.column(ids)))

    return rows.mapInArrow(lean(work), rows.schema)
