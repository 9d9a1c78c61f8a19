"""N-gram Jaccard join: which documents' shingle sets overlap by a threshold, and their groups.

A document's set holds the hashes of its distinct n-word shingles (with fewer words, of the whole
sequence). Two documents link when the sets' intersection is at least ``percent`` hundredths of
their union. All links count, none is estimated:

1. Documents with equal sets are one node. A count sketch of fixed size orders shingles from rare
   to frequent; any function of a shingle is a valid order, so its errors cost time, not links.
2. Linked sets share one of their first n - ceil(t n) + 1 shingles in that order. Sets that share
   such a shingle form a tile.
3. Tiles are cut by size band (linked sizes differ by a factor of t at most). In each, all are
   compared with one member first, that whose prefix others share most: of near copies, one that
   was hardly edited. Linked members are merged.
4. Only tiles that still hold several groups are searched for pairs between these, in blocks of
   ``BLOCK`` sets a side for large ones. Two sets of sizes a and b whose hashed bitmaps differ
   in d bits share at most (a + b - d) / 2 shingles; what that bound allows is compared exactly, as
   sorted arrays. Pairs in one group, as in a large group of near copies, need no comparison.

Hashes have 64 bits; two sets count as equal by a 64-bit sum of mixed hashes.

Defined results: null, empty and blank texts have empty sets and link with nothing; a null id is
never the smallest of a group with others; repeated rows are copies like others. Only the named
columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .lean import lean, lean_group, small_batches
from .packets import PACKET, offered, shared
from .storage import stored
from .words import LOWER, Words, mix, sliced

#: The sketch has 2 ** LEAST_BITS counters (4 bytes each, sent to every task) up to 64 GB of text,
#: and twice as many for each doubling beyond, up to 2 ** MOST_BITS.
LEAST_BITS, MOST_BITS = 21, 24
#: Sets on each side of a block of a large tile.
BLOCK = 2048
#: Sets of a tile whose pairs need no bitmaps first.
SMALL = 8
#: Ids that are sent to every task at most; more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Text bytes whose prefix shingles meet in one group.
BUCKET_BYTES = 24 << 20

#: Bits of the bitmaps that go with the rows of large tiles.
SHORT_BITS = 4096

_CHUNK = 1 << 15


def _sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams, whole = words.ngrams(n)
    for a, b, count in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), words.counts.tolist()):
        if count >= n:
            yield np.unique(grams[a:b][whole[a:b]])
        elif count:
            own = words.hashes[a:b]
            h = np.uint64(count)
            for w in own:
                h = mix(np.array([h ^ w]))[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _set_id(one: np.ndarray) -> int:
    return int(mix(one + np.uint64(len(one))).sum(dtype=np.uint64).view(np.int64))


def _bitmap(one: np.ndarray, each: int, most: int) -> bytes:
    """A bit for each hash: ``each`` times as many bits as hashes or more, up to ``most``."""
    bits = 64
    while bits < min(each * len(one), most):
        bits *= 2
    out = np.zeros(bits, bool)
    out[(one & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


class _Bitmaps:
    """A column of bitmaps as 64-bit words."""

    def __init__(self, column: pa.Array):
        column = pa.concat_arrays([column.cast(pa.large_binary())])
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        self.first, self.size = at[:-1] // 8, np.diff(at) // 8
        self.words = np.frombuffer(data, np.uint64, at[-1] // 8) if at[-1] else np.zeros(0, np.uint64)

    def rows(self, which: np.ndarray, size: int, to: int) -> np.ndarray:
        """Bitmaps of ``size`` words, folded to ``to``."""
        found = self.words[self.first[which][:, None] + np.arange(size)]
        return np.bitwise_or.reduce(found.reshape(len(which), -1, to), axis=1)


def _possible(na: np.ndarray, nb: np.ndarray, a: _Bitmaps, x: np.ndarray, b: _Bitmaps, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (row x of a, row y of b) can link, by the bound that their bitmaps give on the intersection."""
    out = np.ones(len(x), bool)
    sizes = a.size[x] << 32 | b.size[y]
    for both in np.unique(sizes).tolist():
        p, q = both >> 32, both & 0xFFFFFFFF
        at = np.flatnonzero(sizes == both)
        for part in np.array_split(at, 1 + len(at) * max(p, q) // 4_000_000):
            differ = np.bitwise_count(a.rows(x[part], p, min(p, q)) ^ b.rows(y[part], q, min(p, q))).sum(axis=1)
            most = (na[part] + nb[part] - differ) // 2
            out[part] = 100 * most >= percent * (na[part] + nb[part] - most)
    return out


class _Sizes:
    """What the threshold says of set sizes."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, size: int) -> int:
        return size - (self.percent * size + 99) // 100 + 1

    def fit(self, a, b):
        return (100 * a >= self.percent * b) & (100 * b >= self.percent * a)

    def band(self, column: str):
        return F.floor(F.log(F.col(column).cast("double")) / F.log(F.lit(100.0 / self.percent)) + 1e-9).cast("int")


def _sets_table(docs: DataFrame, n: int, bits: int, kind: str) -> DataFrame:
    """(doc_id, row, size, sid, bitmap, short) of each document, and (part, cells): the sketch of each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        empty = ids = None
        for batch in batches:
            for part in sliced(batch):
                ids = part.column("doc_id")
                sets = list(_sets(Words(part.column("text"), LOWER), n))
                every, counts = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                cells[every] += counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [ids, part.column("row"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_set_id(x) if len(x) else None for x in sets], pa.int64()), pa.array([_bitmap(x, 4, 1 << 40) if len(x) else None for x in sets], pa.binary()), pa.array([_bitmap(x, 8, SHORT_BITS) if len(x) else None for x in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                    ["doc_id", "row", "size", "sid", "bitmap", "short", "part", "cells"],
                )
        if ids is not None and cells.any():
            parts = [zlib.compress(cells[a : a + _CHUNK].tobytes(), 1) for a in range(0, len(cells), _CHUNK)]
            empty = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(empty, ids.type), pa.nulls(empty, pa.int64()), pa.nulls(empty, pa.int64()), pa.nulls(empty, pa.int64()), pa.nulls(empty, pa.binary()), pa.nulls(empty, pa.binary()), pa.array(np.arange(empty, dtype=np.int32)), pa.array(parts, pa.binary())],
                ["doc_id", "row", "size", "sid", "bitmap", "short", "part", "cells"],
            )

    return docs.mapInArrow(lean(work), f"doc_id {kind}, row long, size long, sid long, bitmap binary, short binary, part int, cells binary")


def _sketch(table: DataFrame, bits: int) -> np.ndarray:
    """The sum of the tasks' sketches: a fixed number of counters."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for x in group.column("cells").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"part": group.column("part").slice(0, 1), "cells": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    def halve(batches):
        # adds up what a task reads first, so that no task gets a chunk from every other one
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                totals[k] = totals.get(k, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
        for k, x in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary())], ["part", "cells"])

    rows = table.where("part IS NOT NULL").select("part", "cells").mapInArrow(lean(halve), "part int, cells binary")
    out = np.zeros(1 << bits, np.uint32)
    for r in rows.groupBy("part").applyInArrow(lean_group(add), "part int, cells binary").collect():
        out[r.part * _CHUNK : (r.part + 1) * _CHUNK] = np.frombuffer(r.cells, np.uint32)
    return out


def _prefixes(docs: DataFrame, n: int, sizes: _Sizes, sketch: np.ndarray, n_buckets: int) -> DataFrame:
    """(sid, shingle) of the prefix shingles that several sets have."""
    counts, bits = docs.sparkSession.sparkContext.broadcast(sketch), len(sketch).bit_length() - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                grams, keys, seen = [], [], set()
                for one in _sets(Words(part.column("text"), LOWER), n):
                    if not len(one) or (sid := _set_id(one)) in seen:
                        continue
                    seen.add(sid)
                    k = sizes.prefix(len(one))
                    order = np.argsort(counts.value[(one >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:k]
                    grams.append(one[order])
                    keys.append(np.full(k, sid, np.int64))
                if grams:
                    yield from offered(np.concatenate(grams), np.concatenate(keys), n_buckets)

    found = docs.select("text").mapInArrow(lean(work), PACKET).groupBy("bucket").applyInArrow(lean_group(shared), "key long, grams array<long>")
    return found.select(F.col("key").alias("sid"), F.explode("grams").alias("shingle")).distinct()


def _linked(pairs: DataFrame, docs: DataFrame, first: DataFrame, again: DataFrame | None, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets link, compared exactly.

    One document stands for each set. Only where its id and text are repeated (``again``: sid) must
    one of several rows be chosen.
    """
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    wanted = stored(first.join(wanted, "sid", "left_semi").select("sid", F.col("pick.doc_id").alias("doc_id"), F.col("pick.row").alias("row")), "wanted")
    few = wanted.count() <= MOST_BROADCAST

    def work(batches):
        for batch in batches:
            for part in sliced(batch):
                sids, arrays, seen = [], [], set()
                for one, sid in zip(_sets(Words(part.column("text"), LOWER), n), part.column("sid").to_pylist()):
                    if len(one) and _set_id(one) == sid and sid not in seen:
                        seen.add(sid)
                        sids.append(sid)
                        arrays.append(one.tobytes())
                if sids:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(arrays, pa.binary())], ["sid", "shingles"])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["row"] == wanted["row"])
    texts = docs.join(F.broadcast(wanted) if few else wanted, same).select("sid", "text")
    sets = stored(texts.mapInArrow(lean(work), "sid long, shingles binary"), "sets")
    if again is not None:
        sets = sets.join(again, "sid", "left_anti").union(sets.join(again, "sid", "left_semi").dropDuplicates(["sid"]))
    rows = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long")


def _bounded(pairs: DataFrame, nodes: DataFrame, sizes: _Sizes) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow."""

    def work(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            every = np.arange(batch.num_rows)
            keep = sizes.fit(na, nb) & _possible(na, nb, _Bitmaps(batch.column("ma")), every, _Bitmaps(batch.column("mb")), every, sizes.percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda k: nodes.select(F.col("sid").alias(k), F.col("size").alias("n" + k), F.col("bitmap").alias("m" + k))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(lean(work), "a long, b long")


def _between_groups(members: DataFrame, nodes: DataFrame, sizes: _Sizes) -> DataFrame:
    """Pairs (a, b) of different groups in one tile that sizes allow.

    A tile of over SMALL sets is cut by size band; a band and the next one up meet in blocks of BLOCK
    sets a side, and the pairs must pass the bound of short bitmaps, too.
    """
    tiles = members.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("shingle", "n")
    rows = members.join(tiles, "shingle").select("shingle", "n", "sid", "size", "root")
    tile = lambda *more: F.xxhash64("shingle", *more).alias("tile")
    small = rows.where(f"n <= {SMALL}").select(tile(), "sid", "size", "root", F.lit(None).cast("binary").alias("short"))
    big = rows.where(f"n > {SMALL}").join(nodes.select("sid", "short"), "sid").withColumn("low", F.explode(F.array(sizes.band("size"), sizes.band("size") - 1)))
    blocks = F.ceil(F.col("n") / BLOCK)
    big = big.withColumn("own", F.pmod(F.xxhash64("sid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    big = big.select(tile("low", F.least("own", "other"), F.greatest("own", "other")), "sid", "size", "root", "short")
    rows = small.union(big)

    def work(batches):
        left = None
        for batch in batches:
            # rows come ordered by tile; the last tile of a batch may go on in the next
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            tile = table.column("tile").to_numpy()
            cut = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
            left = table.slice(cut)
            yield from pairs(table.slice(0, cut))
        if left is not None:
            yield from pairs(left)

    def pairs(table):
        if table.num_rows < 2:
            return
        tile, sid, size, root = (table.column(c).to_numpy() for c in ("tile", "sid", "size", "root"))
        new = np.ones(len(tile), bool)
        new[1:] = tile[1:] != tile[:-1]
        ends = np.append(np.flatnonzero(new)[1:], len(tile))[np.cumsum(new) - 1]
        column = table.column("short").combine_chunks()
        bare, maps = np.asarray(column.is_null()), _Bitmaps(column)
        at, step, found, n_found = np.arange(len(tile)), 1, [], 0
        while True:
            at = at[at + step < ends[at]]
            hit = at[(root[at] != root[at + step]) & sizes.fit(size[at], size[at + step])]
            found.append((hit, hit + step))
            n_found += len(hit)
            step += 1
            if not len(at) or n_found > 200_000:
                x, y = (np.concatenate(z) for z in zip(*found))
                ok = bare[x].copy()
                ok[~ok] = _possible(size[x[~ok]], size[y[~ok]], maps, x[~ok], maps, y[~ok], sizes.percent)
                x, y = sid[x[ok]], sid[y[ok]]
                a, b = np.minimum(x, y), np.maximum(x, y)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                once = np.ones(len(a), bool)
                once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])
                found, n_found = [], 0
            if not len(at):
                return

    spread = rows.repartition("tile").sortWithinPartitions("tile")
    return spread.mapInArrow(lean(work), "a long, b long").distinct()


def similar_groups(documents: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", chosen: bool = False) -> DataFrame:
    """For each document ``doc_id``, ``n_shingles`` (its set's size) and ``component_id``, the smallest id
    that links lead to.

    With ``chosen`` also ``row``, xxhash64 of the text, and ``stays``: of each component the rows with one id and text,
    those with the smallest id (nulls last), and all documents that are linked with nothing.
    """
    small_batches(documents.sparkSession)
    sizes = _Sizes(percent)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, LEAST_BITS + (total >> 36).bit_length()))
    table = stored(_sets_table(docs, n, bits, kind), "sets")
    own = table.where("part IS NULL").select("doc_id", "row", "size", "sid", "bitmap", "short")
    first = stored(own.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("pick"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.first("short").alias("short")), "nodes")
    prefixes = stored(_prefixes(docs, n, sizes, _sketch(table, bits), int(min(2**31 - 1, 16 + total // BUCKET_BYTES))), "prefixes")
    twice = own.where("sid IS NOT NULL").groupBy("sid", "doc_id", "row").count().where("count > 1").select("sid").distinct()
    twice = stored(twice, "again")
    again = None if twice.isEmpty() else twice
    # what share of its prefix others have too: most for the least edited of near copies
    common = prefixes.groupBy("sid").agg(F.count(F.lit(1)).alias("common")).join(first.select("sid", "size"), "sid")
    common = common.select("sid", "size", (F.col("common") / F.col("size")).alias("common"))
    members = stored(prefixes.join(common, "sid"), "members")

    banded = members.select("sid", "shingle", "common", sizes.band("size").alias("band"))
    centres = banded.groupBy("shingle", "band").agg(F.max_by("sid", F.struct("common", "sid")).alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = banded.join(centres, ["shingle", "band"]).where("sid <> centre").select(F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b")).distinct()
    stars = stored(_bounded(stars, first, sizes), "stars")
    links = stored(_linked(stars, docs, first, again, n, percent), "links")
    roots = components(links)

    grouped = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rest = stored(_bounded(_between_groups(grouped, first, sizes), first, sizes), "rest")
    more = _linked(rest, docs, first, again, n, percent)
    roots = components(links.union(more))

    smallest = first.select("sid", "doc_id", "pick").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = smallest.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("pick").alias("pick"))
    named = smallest.select("sid", "root").join(named, "root").select("sid", "component_id", "pick")
    rows = own.join(named, "sid", "left")
    stays = F.col("sid").isNull() | (F.col("doc_id").eqNullSafe(F.col("pick.doc_id")) & (F.col("row") == F.col("pick.row")))
    more = [F.col("row"), stays.alias("stays")] if chosen else []
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)
