"""Substring deduplication over difference-cover anchors.

A window is ``n`` consecutive words of one document. Every word that lies in a window whose word
sequence also starts in a document with a smaller id goes.

Hashing all windows of the corpus would move a value for each word. A difference cover D modulo a
period v instead has, for any two positions i and j, an offset k < v with both i + k and j + k in
D modulo v. Equal windows at i and j therefore share an aligned anchor: the (n - v + 1)-word gram at
offset k. So only anchors (3 of 7 positions for the period of 7) meet in a first shuffle; windows
over an anchor that a second document has are extended to n words, and those few meet in a second
one, which finds each window's smallest document. Nothing is compared in pairs.

Hashes travel in packets (one row for each slice of a task and bucket), and a slice sends each
anchor or window once, whatever number of its documents have it: what several documents of a
slice share is settled there. A gram that a third of all documents hold is then as many entries as
there are slices, not documents; beyond ``PART_BYTES`` of text, slices are first combined in parts of
about that size, in a shuffle of their own. Buckets get about ``BUCKET_BYTES`` of text each.

Grams and windows are compared by 64-bit hashes.

Defined results: null and empty texts have no words; ids are integers, and a null id counts as
larger than all others; rows with equal ids never remove words from each other; texts of fewer
than n words stay as they are. Only the named columns are read; ``carry`` columns are handed on
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean, lean_group, small_batches
from .packets import PACKET, by_key, combined, groups, least, offered, opened, shared
from .words import PLAIN, Words, sliced

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Text bytes whose anchors meet in one group.
BUCKET_BYTES = 32 << 20
#: Text bytes whose slices are combined before all of them meet.
PART_BYTES = 1 << 40


def _owners(words: Words, part: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of word positions: the document's id as a number, its row key and the position in it."""
    d = np.searchsorted(words.offsets, at, "right") - 1
    return part.column("key").to_numpy()[d], part.column("row").to_numpy()[d], at - words.offsets[d]


def _anchor_positions(words: Words, period: int) -> np.ndarray:
    local = np.arange(len(words)) - np.repeat(words.offsets[:-1], words.counts)
    wanted = np.zeros(period, bool)
    wanted[list(COVERS[period])] = True
    return wanted[local % period]


def deduplicated(documents: DataFrame, n: int = 13, period: int = 7, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``documents`` without the words of windows that a document with a smaller id has.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (the words left, joined by one space;
    null for null texts) and ``carried``, a struct of the ``carry`` columns.
    """
    if period not in COVERS or period > n:
        raise ValueError("period must be one of COVERS and at most n")
    small_batches(documents.sparkSession)
    anchor = n - period + 1
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    last = F.lit(2**63 - 1)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), last).alias("key"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"), carried.alias("carried"))
    total = documents.select(F.sum(F.octet_length(text))).first()[0] or 0
    n_buckets, fan_in = int(min(2**31 - 1, 16 + total // bucket_bytes)), int(-(-total // part_bytes))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                words = Words(part.column("text"), PLAIN)
                grams, whole = words.ngrams(anchor)
                at = np.flatnonzero(whole & _anchor_positions(words, period))
                yield from offered(grams[at], _owners(words, part, at)[1], n_buckets)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                words = Words(part.column("text"), PLAIN)
                grams, whole = words.ngrams(anchor)
                at = np.flatnonzero(whole & _anchor_positions(words, period))
                d = np.searchsorted(words.offsets, at, "right") - 1
                lists = part.column("anchors")
                mine = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                # a document's own anchors only: the document goes into the value
                salt = lambda h, i: h ^ (i.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                hit = at[np.isin(salt(grams[at], d), salt(mine, owner))]
                candidate = np.zeros(len(words), bool)
                for back in range(period):
                    candidate[hit[hit >= back] - back] = True
                grams, whole = words.ngrams(n)
                at = np.flatnonzero(candidate & whole)
                keys, rows, starts = _owners(words, part, at)
                yield from least(grams[at], keys, rows, starts.astype(np.int32), n_buckets)

    def removed_windows(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        g, k, r, s = opened(table.filter(pa.array(~known)))
        order, first, group = groups(g, k)
        if len(first):
            order = order[k[order] > k[order][first][group]]
        _, k2, r2, s2 = opened(table.filter(pa.array(known)))
        k, r, s = np.concatenate([k[order], k2]), np.concatenate([r[order], r2]), np.concatenate([s[order], s2])
        # repeated rows have told the same more than once
        order = np.lexsort((s, r, k))
        k, r, s = k[order], r[order], s[order]
        once = np.ones(len(r), bool)
        once[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        return by_key(("key", "row", "starts"), k[once], r[once], s[once].astype(np.int32))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                words = Words(part.column("text"), PLAIN)
                gone = np.zeros(len(words), bool)
                at = [np.zeros(0, np.int64)]
                own = part.column("key").to_numpy()
                for d, found in enumerate(part.column("removed")):
                    for one in found.values if found.is_valid else ():
                        if one["key"].as_py() == own[d]:
                            at.append(one["starts"].values.to_numpy() + words.offsets[d])
                gone = words.covered(np.concatenate(at), n)
                texts = words.joined(~gone)
                n_removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.offsets[:-1]) * (words.counts > 0) if part.num_rows else []
                kept = pa.array([t if ok else None for t, ok in zip(texts, part.column("text").is_valid().to_pylist())], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), pa.array(n_removed, pa.int64()), kept, part.column("carried")], ["doc_id", "n_words", "n_removed", "kept_text", "carried"])

    told = combined(docs.select("key", "row", "text").mapInArrow(lean(anchors), PACKET), fan_in, offered, n_buckets)
    found = told.groupBy("bucket").applyInArrow(lean_group(shared), "key long, grams array<long>")
    found = found.groupBy(F.col("key").alias("row")).agg(F.flatten(F.collect_list("grams")).alias("anchors"))
    told = combined(docs.join(found, "row").mapInArrow(lean(windows), PACKET), fan_in, least, n_buckets)
    removed = told.groupBy("bucket").applyInArrow(lean_group(removed_windows), "key long, row long, starts array<int>")
    # both joins are on one column, so that the texts are shuffled once
    removed = removed.groupBy("row").agg(F.collect_list(F.struct("key", "starts")).alias("removed"))
    kind, carried_kind = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "carried"))
    return docs.join(removed, "row", "left").mapInArrow(lean(without), f"doc_id {kind}, n_words long, n_removed long, kept_text string, carried {carried_kind}")
