"""Words and word n-grams of many texts at once, as flat numpy arrays.

A batch of texts becomes one array of 64-bit word hashes plus the offsets of the texts in it;
n-grams are then sums over shifted slices of that array. Work goes in slices of a few MB of
text, so that the memory of a task does not depend on the size of its batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_SPACES = b" \t\n\x0b\x0c\r"
_LETTERS = bytes(range(ord("A"), ord("Z") + 1))
_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _table(separators: bytes, lower: bool) -> bytes:
    table = bytearray(range(256))
    for b in separators:
        table[b] = 32
    if lower:
        for b in _LETTERS:
            table[b] = b + 32
    return bytes(table)


#: Words ``[^\x20\x09-\x0D]+`` as they stand; the same with A-Z in lower case; and, in lower
#: case, words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PLAIN = _table(_SPACES, lower=False)
LOWER = _table(_SPACES, lower=True)
LOWER_ALNUM = _table(bytes(b for b in range(128) if b not in _ALNUM), lower=True)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the lowest 0 to 8 bytes.
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """The words of a slice of texts.

    ``offsets[d]`` to ``offsets[d + 1]`` are the words of text d; null texts have none.
    ``data`` holds the words' bytes without anything between them, ``bounds`` where each starts.
    """

    def __init__(self, texts: pa.Array, table: bytes):
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8).copy()
        raw = b"" if data is None else bytes(memoryview(data)[at[0] : at[-1]]).translate(table)
        at -= at[0]
        chars = np.frombuffer(raw, np.uint8)
        inside = chars != 32
        before = np.empty(len(chars), bool)
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(chars)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(chars), bool)
        after[:-1] = inside[1:]
        last = at[1:] - 1
        after[last[last >= 0]] = False
        lengths = np.flatnonzero(inside & ~after) + 1 - starts
        self.offsets = np.searchsorted(starts, at)
        self.data = chars[inside].tobytes()
        self.bounds = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=self.bounds[1:])
        self.counts = np.diff(self.offsets)
        self.ends = np.repeat(self.offsets[1:], self.counts)
        self._hashes = None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes at a time, words of over 64 bytes by xxHash."""
        if self._hashes is None:
            starts, lengths = self.bounds[:-1], np.diff(self.bounds)
            lanes = np.ndarray((len(self.data) + 1,), "<u8", self.data + bytes(8), strides=(1,))
            h = mix(lengths.astype(np.uint64) + _MULTIPLIER)
            todo = np.arange(len(h))
            for lane in range(8):
                left = lengths[todo] - 8 * lane
                todo, left = todo[left > 0], left[left > 0]
                if not len(todo):
                    break
                value = lanes[starts[todo] + 8 * lane] & _BELOW[np.minimum(left, 8)]
                h[todo] = mix(h[todo] * _MULTIPLIER + value)
            for k in np.flatnonzero(lengths > 64).tolist():
                h[k] = xxhash.xxh3_64_intdigest(self.data[starts[k] : starts[k] + lengths[k]])
            self._hashes = h
        return self._hashes

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows, by the word they start at, and which of them lie in one text.

        Both have an entry for each word; those of windows that run over a text's end are false.
        """
        words = self.hashes
        out, m = np.zeros(len(words), np.uint64), len(words) - n + 1
        if m > 0:
            h = words[:m].copy()
            for j in range(1, n):
                h *= _MULTIPLIER
                h += words[j : j + m]
            out[:m] = mix(h)
        return out, np.arange(n, len(words) + n) <= self.ends

    def covered(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in one of the n-word windows that start at ``starts``."""
        edge = np.zeros(len(self) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.subtract.at(edge, np.minimum(starts + n, len(self)), 1)
        return np.cumsum(edge[:-1]) > 0

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Each text's kept words, joined by one space."""
        kept = np.flatnonzero(keep)
        lengths = np.diff(self.bounds)[kept] + 1
        stops = np.cumsum(lengths)
        chars = np.frombuffer(self.data, np.uint8)
        mask = np.repeat(keep, np.diff(self.bounds))
        out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
        body = np.ones(len(out), bool)
        body[stops - 1] = False
        out[body] = chars[mask]
        per_text = np.searchsorted(kept, self.offsets)
        ends = np.concatenate([[0], stops])[per_text]
        raw = out.tobytes()
        return [raw[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
