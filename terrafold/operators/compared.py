"""Pairs of places within a distance, compared where they meet (JOIN-2 to 4, PRJ-17).

A pair's names, brands and distance are much to carry and little to keep: here tiles of the ground bring both sides
together, and only what was asked for leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import chain, groupby
from math import degrees, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geo import EARTH_M
from terrafold.functions.text import LENGTHS, letters, matched_shares

#: Candidates of a group at about, rows of the smaller side in a group, and tiles with more that go to every task at most.
CANDIDATES = 8_000_000
MOST_HELD = 20_000
MOST_HEAVY = 50_000
#: Distances measured at a time, and pairs of a batch on its way out.
MEASURED, PAIRS = 200_000, 100_000

KEYS = ("_ti", "_tj", "_deal", "_to")
#: What can be told of a pair. ``differ``: brands or classes that are known differ; ``similarity`` is null for such pairs.
NUMBERS = ("metres", "words", "similarity")
FLAGS = ("differ", "same_brand", "same_class", "r_unnamed")


def compared(left: DataFrame, right: DataFrame, metres: float, tell: Sequence[str]) -> DataFrame:
    """``place_id`` and ``r_place_id`` of the pairs within a distance, and of each what ``tell`` names (of ``NUMBERS`` and ``FLAGS``).

    Both sides have ``place_id``, ``brand``, ``class``, ``tokens``, ``lon``, ``lat``. The side with fewer rows stands in all tiles that the
    box around its circle meets. Rows of the tiles are counted first: tasks follow the candidates, and of a tile with many
    both sides are dealt out, so a group holds at most some ``MOST_HELD`` rows; the other side streams past them.
    Latitudes and the 180th meridian as in ``spatial.near``.
    """
    both, swap, kind = _tiles(left, right, metres)
    numbers = [n for n in NUMBERS if n in tell]
    # flags leave a task as bits of one byte
    schema = ", ".join([f"place_id {kind}, r_place_id {kind}", *[f"{n} double" for n in numbers], "flags tinyint"])
    rows = both.mapInArrow(_streamed(partial(_all, metres=metres, swap=swap, numbers=numbers, flags=bool(set(FLAGS) & set(tell)))), schema)
    bit = lambda name: (F.col("flags").bitwiseAND(F.lit(1 << FLAGS.index(name)).cast("tinyint")) != 0).alias(name)
    return rows.select("place_id", "r_place_id", *[bit(name) if name in FLAGS else name for name in tell])


def best_compared(left: DataFrame, right: DataFrame, metres: float, most: int, rank: Callable[..., np.ndarray]) -> DataFrame:
    """Of the same pairs the ``most`` best of each place of the smaller side, or more of them, with ``score``; other pairs never leave a task.

    ``rank`` makes scores of the arrays metres, similarity, same_brand and same_class; it grows with similarity, nan stands for no name, and pairs
    with nan as their score don't count. Ids are integers and break ties.
    """
    both, swap, kind = _tiles(left, right, metres)
    return both.mapInArrow(_streamed(partial(_best, metres=metres, swap=swap, most=most, rank=rank)), f"place_id {kind}, r_place_id {kind}, score double")


def _tiles(left: DataFrame, right: DataFrame, metres: float) -> tuple[DataFrame, bool, str]:
    """Both sides' rows by tiles, and whether the smaller one, which comes first in a group, is the left one."""
    angle = _angle(metres)
    size = degrees(angle)
    tile = 2 * size
    columns = ["place_id", "brand", "class", "tokens", "lon", "lat"]
    known = lambda rows: rows.select(*columns).where("lon IS NOT NULL AND lat IS NOT NULL")
    left = known(left.withColumn("lat", F.when(F.abs("lat") > 60, F.raise_error(F.lit("latitudes beyond 60 degrees"))).otherwise(F.col("lat"))))
    right = known(right)
    swap = left.count() <= right.count()
    few, many = (left, right) if swap else (right, left)
    across = F.when(F.abs("lat") + size < 90, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians("lat")))))).otherwise(360.0)
    cell = lambda v: F.floor(v / tile).cast("int")
    spread = lambda v, d: F.explode(F.sequence(cell(v - d), cell(v + d)))
    few = few.withColumn("_ti", spread(F.col("lon"), across)).withColumn("_tj", spread(F.col("lat"), F.lit(size)))
    many = many.withColumns({"_ti": cell(F.col("lon")), "_tj": cell(F.col("lat"))})
    count = lambda rows, n: rows.groupBy("_ti", "_tj").agg(F.count(F.lit(1)).alias(n))
    work = count(few, "_m").join(count(many, "_n"), ["_ti", "_tj"]).checkpoint()
    cuts = F.ceil(F.col("_m") / MOST_HELD).cast("int")
    work = work.select("_ti", "_tj", "_n", "_m", cuts.alias("_cuts"), F.least(F.ceil(F.col("_n") * F.col("_m") / cuts / CANDIDATES), F.col("_n")).cast("int").alias("_deals"))
    heavy = (F.col("_cuts") > 1) | (F.col("_deals") > 1)
    pairs, rows, tiles = work.agg(F.sum(F.col("_n") * F.col("_m")), F.sum(F.col("_n") * F.col("_cuts") + F.col("_m") * F.col("_deals")), F.count_if(heavy)).first()
    parts = 1 + int(max((pairs or 0) // CANDIDATES, (rows or 0) // 250_000))
    heavy = work.where(heavy).select("_ti", "_tj", "_cuts", "_deals")
    heavy = F.broadcast(heavy) if tiles <= MOST_HEAVY else heavy

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        """A row has one deal of its own side's, and stands in all of the other's."""
        if not tiles:
            return side.withColumns({own: F.lit(0), other: F.lit(0)})
        side = side.join(heavy, ["_ti", "_tj"], "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in ("_cuts", "_deals")})
        side = side.withColumn(own, F.pmod(F.xxhash64("place_id"), F.col(own_n)).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("_cuts", "_deals")

    few = dealt(few, "_to", "_cuts", "_deal", "_deals").withColumn("_side", F.lit(0))
    many = dealt(many, "_deal", "_deals", "_to", "_cuts").withColumn("_side", F.lit(1))
    both = few.unionByName(many).repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "_side").select(*KEYS, "_side", *columns)
    return both, swap, left.schema["place_id"].dataType.simpleString()


def _angle(metres: float) -> float:
    # a little more than the distance, so that rounding loses nothing
    return metres / EARTH_M * 1.000001


class _Places:
    """Rows of one side in a group, as arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        one = lambda name: table.column(name).chunk(0) if table.num_rows else table.column(name).combine_chunks()
        self.ids, self.brand, self.kind, self.tokens = (one(c) for c in ("place_id", "brand", "class", "tokens"))
        self.lon, self.lat = (one(c).to_numpy() for c in ("lon", "lat"))
        self.n = table.num_rows
        lon, lat = np.radians(self.lon), np.radians(self.lat)
        self.cos = np.cos(lat)
        self.spot = np.stack([self.cos * np.cos(lon), self.cos * np.sin(lon), np.sin(lat)])
        self.unnamed = self.tokens.is_null().to_numpy(zero_copy_only=False)
        self._texts = None

    def texts(self) -> tuple[pa.Array, tuple]:
        if self._texts is None:
            joined = pc.binary_join(self.tokens.cast(pa.list_(pa.string())), " ")
            self._texts = joined, letters(joined)
        return self._texts

    def words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many different words a row has, and the numbers of those among ``names``, filled up by -1."""
        counts = pc.list_value_length(self.tokens).fill_null(0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(self.tokens)
        own = flat.dictionary_encode()
        row, word = np.repeat(np.arange(self.n), counts), own.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row, word = np.divmod(np.unique(row * max(len(own.dictionary), 1) + word), max(len(own.dictionary), 1))
        size = np.bincount(row, minlength=self.n)
        number = pc.index_in(own.dictionary, names).fill_null(-1).to_numpy(zero_copy_only=False)
        row, number = row[number[word] >= 0], number[word][number[word] >= 0]
        shared = np.bincount(row, minlength=self.n)
        out = np.full((int(shared.max(initial=0)), self.n), -1, np.int32)
        out[np.arange(len(row)) - (np.cumsum(shared) - shared)[row], row] = number
        return size, out


def _codes(held: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for equal values of both; null is -1, and what only the other has is -2."""
    values = held.unique().drop_null()
    a = pc.index_in(held, values).fill_null(-1)
    b = pc.if_else(other.is_null(), -1, pc.index_in(other, values).fill_null(-2))
    return a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)


def _haversine(a: _Places, b: _Places, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    dlat, dlon = np.radians(b.lat[j] - a.lat[i]) / 2, np.radians(b.lon[j] - a.lon[i]) / 2
    h = np.sin(dlat) ** 2 + a.cos[i] * b.cos[j] * np.sin(dlon) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _near(held: _Places, other: _Places, metres: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the distance, some at a time: squares of a tile meet what their boxes can reach."""
    angle = _angle(metres)
    size = degrees(angle)
    across = np.where(np.abs(held.lat) + size < 90, np.degrees(np.arcsin(np.minimum(1.0, sin(angle) / held.cos))), 360.0)
    # chords, squared: what is clearly nearer or farther needs no measuring
    limit = (2 * sin(metres / EARTH_M / 2)) ** 2
    n = int(np.clip(round((held.n * other.n / 60_000) ** 0.5), 1, 24))
    place = lambda v: np.minimum(((v - v.min()) / max((v.max() - v.min()) / n, 1e-12)).astype(np.int64), n - 1)
    square = place(other.lat) * n + place(other.lon)
    order = np.argsort(square, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(square[order]) > 0])
    for s, e in zip(starts, np.r_[starts[1:], len(order)]):
        own = order[s:e]
        x, y = other.lon[own], other.lat[own]
        at = np.flatnonzero((held.lat >= y.min() - size) & (held.lat <= y.max() + size) & (held.lon >= x.min() - across * 1.000001) & (held.lon <= x.max() + across * 1.000001))
        if not len(at):
            continue
        spots = held.spot[:, at]
        step = max(1, MEASURED // len(at))
        for k in range(0, len(own), step):
            mine = own[k : k + step]
            square_of, off = np.zeros((len(mine), len(at))), np.empty((len(mine), len(at)))
            for axis in range(3):
                np.subtract(other.spot[axis, mine][:, None], spots[axis], out=off)
                off *= off
                square_of += off
            hit = np.flatnonzero(square_of <= limit * (1 + 1e-8))
            j = hit // len(at)
            i, j = at[hit - j * len(at)], mine[j]
            doubt = np.flatnonzero(square_of.ravel()[hit] > limit * (1 - 1e-8))
            if len(doubt):
                out = doubt[_haversine(held, other, i[doubt], j[doubt]) > metres]
                i, j = np.delete(i, out), np.delete(j, out)
            yield i, j


class _Pairs:
    """Pairs (i, j) of held and other places; ``swap`` if the held side is the left one."""

    def __init__(self, held: _Places, other: _Places, swap: bool):
        self.held, self.other, self.swap = held, other, swap
        self.brand, self.kind = (_codes(a, b) for a, b in ((held.brand, other.brand), (held.kind, other.kind)))
        names = pc.list_flatten(held.tokens).unique()
        self.names = held.words(names), other.words(names)

    def flags(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        differ = [(c[0][i] >= 0) & (c[1][j] != -1) & (c[0][i] != c[1][j]) for c in (self.brand, self.kind)]
        same = [(c[0][i] >= 0) & (c[0][i] == c[1][j]) for c in (self.brand, self.kind)]
        return dict(zip(FLAGS, (differ[0] | differ[1], *same, self.other.unnamed[j] if self.swap else self.held.unnamed[i])))

    def words(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The share of common words; nan where a side has none."""
        (na, a), (nb, b) = self.names
        both = np.zeros(len(i), np.int64)
        theirs = [y[j] for y in b]
        for x in a:
            mine = x[i]
            known = mine >= 0
            for y in theirs:
                both += (mine == y) & known
        return np.where((na[i] > 0) & (nb[j] > 0), both / np.maximum(na[i] + nb[j] - both, 1), np.nan)

    def matched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The share of letters in matching blocks, of the left name first."""
        (a, made_a), (b, made_b) = self.held.texts(), self.other.texts()
        return matched_shares(a, b, i, j, (made_a, made_b)) if self.swap else matched_shares(b, a, j, i, (made_b, made_a))

    def most_matched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """No less than ``matched``: the share of letters that both names have, wherever they stand."""
        (a, (ma, na)), (b, (mb, nb)) = self.held.texts(), self.other.texts()
        used = np.unique(ma)
        if len(used) > 64 or any(pc.max(pc.utf8_length(t)).as_py() > LENGTHS[-1] for t in (a, b)):
            return np.ones(len(i))
        if not hasattr(self, "_counts"):
            # letters are nonzero, what fills a row up is zero
            self._counts = [np.stack([(m == c).sum(axis=1, dtype=np.uint8) for c in used if c], axis=1) for m in (ma, mb)]
        both = np.minimum(self._counts[0][i], self._counts[1][j]).sum(axis=1, dtype=np.int64)
        return 2.0 * both / np.maximum(na[i] + nb[j], 1)

    def ids(self, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
        both = [self.held.ids.take(pa.array(i)), self.other.ids.take(pa.array(j))]
        return both if self.swap else both[::-1]


def _some(held: _Places, other: _Places, metres: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs, about ``PAIRS`` at a time."""
    found, n = [], 0
    for i, j in _near(held, other, metres):
        found.append((i, j))
        n += len(i)
        if n >= PAIRS:
            yield tuple(map(np.concatenate, zip(*found)))
            found, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*found)))


def _all(held: _Places, others: Iterator[_Places], metres: float, swap: bool, numbers: Sequence[str], flags: bool) -> Iterator[pa.RecordBatch]:
    """What is told of all pairs of a group."""
    for other in others:
        pairs = None
        for i, j in _some(held, other, metres):
            pairs = pairs or _Pairs(held, other, swap)
            told, bits = pairs.flags(i, j), np.zeros(len(i), np.int8)
            for k, name in enumerate(FLAGS if flags else ()):
                bits |= told[name].view(np.int8) << k
            out = {"metres": _haversine(held, other, i, j) if "metres" in numbers else None}
            if "words" in numbers or "similarity" in numbers:
                out["words"] = pairs.words(i, j)
            if "similarity" in numbers:
                alike = np.where(told["differ"], np.nan, out["words"])
                ask = np.flatnonzero(alike < 1)
                if len(ask):
                    alike[ask] = np.maximum(alike[ask], pairs.matched(i[ask], j[ask]))
                out["similarity"] = alike
            columns = [pa.array(out[n], mask=np.isnan(out[n])) for n in numbers]
            yield pa.RecordBatch.from_arrays([*pairs.ids(i, j), *columns, pa.array(bits)], ["place_id", "r_place_id", *numbers, "flags"])


def _best(held: _Places, others: Iterator[_Places], metres: float, swap: bool, most: int, rank: Callable[..., np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The best pairs of the held places of a group: names are compared only where a pair could still be among them."""
    bar = np.full(held.n, -np.inf)
    whose, what, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for other in others:
        pairs = None
        for i, j in _some(held, other, metres):
            pairs = pairs or _Pairs(held, other, swap)
            told = pairs.flags(i, j)
            at = np.flatnonzero(~told["differ"])
            i, j, brand, kind = i[at], j[at], told["same_brand"][at], told["same_class"][at]
            far, alike = _haversine(held, other, i, j), pairs.words(i, j)
            # bounds of the score, each closer and dearer than the one before
            for bound in (lambda i, j: np.ones(len(i)), pairs.most_matched, pairs.matched):
                ask = np.flatnonzero(alike < 1)
                could = alike.copy()
                if len(ask):
                    could[ask] = np.maximum(alike[ask], bound(i[ask], j[ask]))
                top = rank(far, could, brand, kind)
                at = np.flatnonzero(top >= bar[i])
                i, j, brand, kind, far, alike, top = (c[at] for c in (i, j, brand, kind, far, alike, top))
            if not len(i):
                continue
            whose, what, score = np.r_[whose, i], np.r_[what, other.ids.to_numpy()[j]], np.r_[score, top]
            order = np.lexsort((what, -score, whose))
            whose, what, score = whose[order], what[order], score[order]
            starts = np.searchsorted(whose, np.arange(held.n + 1))
            keep = np.arange(len(whose)) - starts[whose] < most
            full = np.flatnonzero(np.diff(starts) >= most)
            bar[full] = score[starts[full] + most - 1]
            whose, what, score = whose[keep], what[keep], score[keep]
    if len(whose):
        ids = [held.ids.take(pa.array(whose)), pa.array(what).cast(held.ids.type)]
        yield pa.RecordBatch.from_arrays([*(ids if swap else ids[::-1]), pa.array(score)], ["place_id", "r_place_id", "score"])


def _streamed(work: Callable[[_Places, Iterator[_Places]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on each group of sorted rows: the held side whole, the other one as it comes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], int, pa.RecordBatch]]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in range(len(KEYS) + 1)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
                *key, side = keys[:, s].tolist()
                yield tuple(key), side, b.slice(int(s), int(e - s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(parts(batches), key=lambda p: p[0]):
            rows = []
            for _, side, part in group:
                if side == 0:
                    rows.append(part)
                    continue
                if rows:
                    yield from work(_Places(rows), (_Places([p]) for p in chain([part], (p for _, _, p in group))))
                break

    return run
