"""Benchmark decontamination by winnowing.

A window is ``n`` consecutive words of a benchmark item (an item of fewer words, but not none, is
one window of its own length). Each window's fingerprint is the smallest hash of the k-word grams
in it; a text's fingerprints are the smallest gram hashes of its own windows. A window that occurs
in a text therefore always shares its fingerprint with it: only places with a known fingerprint
are extended to whole windows and compared.

The benchmark's windows go to every task while there are at most ``MOST_BROADCAST`` of them;
beyond, fingerprints and windows are joined by shuffles instead, with the same result.

Defined results: a null or empty text has no words and no hits; equal items all count; an item
whose id is null counts under the name ``null``; repeated documents each get their own row; an
empty benchmark hits nothing. Only the named columns are read; ``carry`` columns are
handed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean, small_batches
from .words import LOWER_ALNUM, Words, sliced

#: Windows times items that are sent to every task at most (about 30 bytes each).
MOST_BROADCAST = 1_000_000

_RESULT = "doc_id {}, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>, carried {}"


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` consecutive gram hashes, by the first."""
    low = grams.copy()
    for j in range(1, width):
        low[:-j] = np.minimum(low[:-j], grams[j:])
    return low


def _windows_of(words: Words, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Of windows of n words: hash, fingerprint, and which are whole."""
    hashes, whole = words.ngrams(n)
    grams, _ = words.ngrams(k)
    return hashes, _window_minima(grams, n - k + 1), whole


def benchmark_windows(benchmark: DataFrame, n: int, k: int, item_id: str, text: str) -> DataFrame:
    """Distinct (width, hash, fingerprint, item) of the windows of ``benchmark``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                words = Words(part.column("text"), LOWER_ALNUM)
                owner = np.repeat(np.arange(part.num_rows), words.counts)
                size = words.counts[owner]
                for width in [n, *np.unique(size[size < n]).tolist()]:
                    if width < n:
                        hashes, whole = words.ngrams(width)
                        low, mine = hashes, whole & (size == width)
                    else:
                        hashes, low, mine = _windows_of(words, n, k)
                    at = np.flatnonzero(mine)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), width, np.int32)), pa.array(hashes[at].view(np.int64)), pa.array(low[at].view(np.int64)), part.column("item").take(pa.array(owner[at]))],
                        ["width", "hash", "fingerprint", "item"],
                    )

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(work), "width int, hash long, fingerprint long, item string").distinct()


@dataclass
class _Known:
    """The benchmark's windows of one width: sorted hashes, and the items of each."""

    width: int
    hashes: np.ndarray
    fingerprints: np.ndarray
    first: np.ndarray
    items: np.ndarray


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted array ``known``, -1 if it isn't there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _hits(words: Words, known: list[_Known], n: int, k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, _Known]]:
    """Starts and width of the known windows in ``words``, and which windows they are."""
    for one in known:
        if not len(words):
            return
        if one.width == n:
            hashes, low, whole = _windows_of(words, n, k)
            new = np.ones(len(low), bool)
            new[1:] = low[1:] != low[:-1]
            runs = np.flatnonzero(new)
            kept = _member(low[runs], one.fingerprints) >= 0
            kept = np.repeat(kept, np.diff(np.append(runs, len(low))))
            at = np.flatnonzero(kept & whole)
        else:
            hashes, whole = words.ngrams(one.width)
            at = np.flatnonzero(whole)
        which = _member(hashes[at], one.hashes)
        found = which >= 0
        yield at[found], one.width, which[found], one


def _spans(words: Words, hit: np.ndarray) -> pa.Array:
    """Runs of hit words of each text."""
    before = np.zeros(len(hit), bool)
    before[1:] = hit[:-1]
    first = words.offsets[:-1][words.counts > 0]
    before[first] = False
    after = np.zeros(len(hit), bool)
    after[:-1] = hit[1:]
    after[words.offsets[1:][words.counts > 0] - 1] = False
    starts, ends = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    bounds = np.searchsorted(starts, words.offsets)
    base = np.repeat(words.offsets[:-1], np.diff(bounds))
    runs = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs)


def _known(rows: pa.Table) -> tuple[list[_Known], list[str]]:
    names = sorted(rows.column("item").unique().to_pylist())
    items = pc.index_in(rows.column("item"), pa.array(names, pa.string())).to_numpy()
    widths, hashes, fingerprints = (rows.column(c).to_numpy() for c in ("width", "hash", "fingerprint"))
    out = []
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        own = hashes[mine].view(np.uint64)
        order = np.argsort(own, kind="stable")
        each, first = np.unique(own[order], return_index=True)
        out.append(_Known(width, each, np.unique(fingerprints[mine].view(np.uint64)), np.append(first, len(order)), items[mine][order]))
    return out, names


def _by_broadcast(docs: DataFrame, windows: DataFrame, n: int, k: int, kinds: tuple[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_known(windows.toArrow()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = shared.value
        for batch in batches:
            for part in sliced(batch):
                words = Words(part.column("text"), LOWER_ALNUM)
                hit, found = np.zeros(len(words), bool), [set() for _ in range(part.num_rows)]
                for starts, width, which, one in _hits(words, known, n, k):
                    hit |= words.covered(starts, width)
                    for d, w in zip((np.searchsorted(words.offsets, starts, "right") - 1).tolist(), which.tolist()):
                        found[d].update(one.items[one.first[w] : one.first[w + 1]].tolist())
                items = pa.array([[names[i] for i in sorted(x)] for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), _spans(words, hit), items, part.column("carried")], ["doc_id", "n_words", "spans", "item_ids", "carried"])

    return docs.select("doc_id", "text", "carried").mapInArrow(lean(work), _RESULT.format(*kinds))


def _by_join(docs: DataFrame, windows: DataFrame, n: int, k: int, kinds: tuple[str, str]) -> DataFrame:
    """For benchmarks of any size: fingerprints first tell which documents matter, and only
    their windows are joined."""
    widths = [r.width for r in windows.select("width").distinct().collect()]
    docs = docs.select("doc_id", "text", "carried", F.xxhash64("doc_id", "text").alias("key"))

    def fingerprints(batches):
        for batch in batches:
            for part in sliced(batch):
                words = Words(part.column("text"), LOWER_ALNUM)
                owner = np.repeat(np.arange(part.num_rows), words.counts)
                for width in widths:
                    hashes, low, whole = _windows_of(words, n, k) if width == n else (*(2 * words.ngrams(width)[:1]), words.ngrams(width)[1])
                    at = np.flatnonzero(whole)
                    new = np.ones(len(at), bool)
                    new[1:] = (low[at][1:] != low[at][:-1]) | (owner[at][1:] != owner[at][:-1])
                    at = at[new]
                    yield pa.RecordBatch.from_arrays([pa.array(low[at].view(np.int64)), part.column("key").take(pa.array(owner[at]))], ["fingerprint", "key"])

    def places(batches):
        for batch in batches:
            for part in sliced(batch):
                words = Words(part.column("text"), LOWER_ALNUM)
                owner = np.repeat(np.arange(part.num_rows), words.counts)
                for width in widths:
                    hashes, whole = words.ngrams(width)
                    at = np.flatnonzero(whole)
                    start = (at - words.offsets[owner[at]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width, np.int32)), pa.array(hashes[at].view(np.int64)), part.column("key").take(pa.array(owner[at])), pa.array(start)], ["width", "hash", "key", "start"])

    def spans(batches):
        for batch in batches:
            for part in sliced(batch):
                words, hit = Words(part.column("text"), LOWER_ALNUM), None
                hit = np.zeros(len(words), bool)
                for d, found in enumerate(part.column("places").to_pylist()):
                    for p in found or ():
                        hit[words.offsets[d] + p["start"] : words.offsets[d] + p["start"] + p["width"]] = True
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), _spans(words, hit), part.column("item_ids"), part.column("carried")], ["doc_id", "n_words", "spans", "item_ids", "carried"])

    marked = docs.select("text", "key").mapInArrow(lean(fingerprints), "fingerprint long, key long").join(windows.select("fingerprint").distinct(), "fingerprint", "left_semi").select("key").distinct()
    found = docs.join(marked, "key", "left_semi").select("text", "key").mapInArrow(lean(places), "width int, hash long, key long, start int").distinct()
    found = found.join(windows.select("width", "hash", "item"), ["width", "hash"])
    found = found.groupBy("key").agg(F.collect_set(F.struct("start", "width")).alias("places"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    rows = docs.join(found, "key", "left").select("doc_id", "text", "carried", "places", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return rows.mapInArrow(lean(spans), _RESULT.format(*kinds))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: Sequence[str] = (), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Where windows of ``benchmark`` occur in ``documents``.

    Returns, for each document, ``doc_id``, ``n_words``, ``spans`` (runs of words, from 0, that lie in
    an occurrence: start, end), ``item_ids`` (items with an occurring window, sorted as strings) and
    ``carried``, a struct of the ``carry`` columns.
    """
    small_batches(documents.sparkSession)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), carried.alias("carried"))
    windows = benchmark_windows(benchmark, n, k, item_id, item_text)
    kinds = tuple(docs.schema[c].dataType.simpleString() for c in ("doc_id", "carried"))
    few = windows.limit(most_broadcast + 1).count() <= most_broadcast
    return (_by_broadcast if few else _by_join)(docs, windows, n, k, kinds)
