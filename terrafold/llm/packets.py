"""Hashes on their way between tasks, many to a row.

A packet is what one slice of a task sends to one bucket: grams (hashes), each with the key of the
document it comes from, a row value and perhaps a start. Known packets only carry on what the
slice has settled itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lean import lean_group

PACKET = "bucket int, known boolean, grams array<long>, keys array<long>, rows array<long>, runs array<int>, starts array<int>"


_FIELDS = [c.split()[0] for c in PACKET.split(", ")]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def packets(buckets: np.ndarray, known: bool, grams: np.ndarray, keys: np.ndarray, rows: np.ndarray, starts: np.ndarray | None) -> pa.RecordBatch:
    """A row for each bucket; keys and rows are run-length coded."""
    order = np.lexsort((keys, buckets))
    buckets, grams, keys, rows = buckets[order], grams[order], keys[order], rows[order]
    new = np.ones(len(order), bool)
    new[1:] = buckets[1:] != buckets[:-1]
    first = np.flatnonzero(new)
    bounds = np.append(first, len(order))
    turn = new.copy()
    turn[1:] |= (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    runs = np.flatnonzero(turn)
    run_bounds = np.searchsorted(runs, bounds)
    lengths = np.diff(np.append(runs, len(order))).astype(np.int32)
    start_lists = pa.array([None] * len(first), pa.list_(pa.int32())) if starts is None else lists(starts[order], bounds)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[first].astype(np.int32)), pa.array(np.full(len(first), known)), lists(grams.view(np.int64), bounds), lists(keys[runs], run_bounds), lists(rows[runs], run_bounds), lists(lengths, run_bounds), start_lists],
        ["bucket", "known", "grams", "keys", "rows", "runs", "starts"],
    )


def opened(table: pa.Table) -> tuple[np.ndarray, ...]:
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    runs = flat("runs")
    return flat("grams"), np.repeat(flat("keys"), runs), np.repeat(flat("rows"), runs), flat("starts")


def by_key(names: Sequence[str], keys: np.ndarray, rows: np.ndarray | None, values: np.ndarray) -> pa.Table:
    """A row for each key (and text) with its values."""
    order = np.argsort(keys, kind="stable") if rows is None else np.lexsort((rows, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if rows is not None:
        rows = rows[order]
        new[1:] |= rows[1:] != rows[:-1]
    first = np.flatnonzero(new)
    columns = [pa.array(keys[first])] + ([] if rows is None else [pa.array(rows[first])]) + [lists(values, np.append(first, len(keys)))]
    return pa.table(columns, names=list(names))


def groups(grams: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by gram and key; starts of the groups of a gram, and the group of each."""
    order = np.lexsort((keys, grams))
    g = grams[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def bucket_of(values: np.ndarray, n_buckets: int) -> np.ndarray:
    return (values ^ (values >> np.uint64(29))) % np.uint64(n_buckets)


def offered(grams: np.ndarray, keys: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """What a slice tells of its grams, so that ``shared`` finds those that several keys have.

    Each gram goes to its bucket once, under its smallest key; where several keys of the slice have
    it, all of them are told directly.
    """
    order, first, group = groups(grams, keys)
    if not len(first):
        return
    g, k = grams[order], keys[order]
    once = np.ones(len(g), bool)
    once[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    several = np.add.reduceat(once, first) > 1
    zero = np.zeros(len(g), np.int64)
    yield packets(bucket_of(g[first], n_buckets), False, g[first], k[first], zero[first], None)
    told = once & several[group]
    if told.any():
        yield packets(bucket_of(k[told].view(np.uint64), n_buckets), True, g[told], k[told], zero[told], None)


def least(grams: np.ndarray, keys: np.ndarray, rows: np.ndarray, starts: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """What a slice tells of its grams, so that those under a larger key than their smallest are found.

    A gram goes to its bucket under its smallest key; under all others it is told directly, to the
    bucket of the row.
    """
    order, first, group = groups(grams, keys)
    if not len(first):
        return
    g, k, r, s = grams[order], keys[order], rows[order], starts[order]
    low = k == k[first][group]
    yield packets(bucket_of(g[low], n_buckets), False, g[low], k[low], r[low], s[low])
    if not low.all():
        yield packets(bucket_of(r[~low].view(np.uint64), n_buckets), True, g[~low], k[~low], r[~low], s[~low])


def part_of(fan_in: int) -> Column:
    """The part of a packet, by what it holds: a task that runs again, in another order, sends each packet where it was
    sent before."""
    return F.pmod(F.xxhash64(*_FIELDS), F.lit(fan_in))


def combined(found: DataFrame, fan_in: int, tell: Callable[..., Iterator[pa.RecordBatch]], n_buckets: int) -> DataFrame:
    """Packets with those of ``fan_in`` parts of the input settled among themselves first.

    A gram that all slices have is one entry for each of them in its bucket; after this it is one
    for each part. With one part there is nothing to do.
    """
    if fan_in <= 1:
        return found

    def work(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        done = table.filter(pa.array(known)).select(_FIELDS).to_batches()
        grams, keys, rows, starts = opened(table.filter(pa.array(~known)))
        given = (grams.view(np.uint64), keys) if tell is offered else (grams.view(np.uint64), keys, rows, starts.astype(np.int32))
        return pa.Table.from_batches([*done, *tell(*given, n_buckets)], schema=table.select(_FIELDS).schema)

    return found.withColumn("part", part_of(fan_in)).groupBy("part", "bucket").applyInArrow(lean_group(work), PACKET)


def shared(table: pa.Table) -> pa.Table:
    """Of a bucket's packets: each key with its grams that other keys have too (key, grams), each once."""
    known = table.column("known").to_numpy()
    g, k, _, _ = opened(table.filter(pa.array(~known)))
    order, first, group = groups(g, k)
    sorted_k = k[order]
    if len(first):
        several = sorted_k[first] != sorted_k[np.append(first[1:], len(g)) - 1]
        order = order[several[group]]
    g2, k2, _, _ = opened(table.filter(pa.array(known)))
    g, k = np.concatenate([g[order], g2]), np.concatenate([k[order], k2])
    order, _, _ = groups(g, k)
    g, k = g[order], k[order]
    once = np.ones(len(g), bool)
    once[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return by_key(("key", "grams"), k[once], None, g[once])
