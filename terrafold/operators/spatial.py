"""Spatial joins as equi-joins on grid cells (JOIN-2, 5 to 13, 20, 21, 23, 25, GEO-5).

Spark has no spatial join of its own: a range predicate would be compared for all pairs. Here each
side is laid on a grid, polygons under every cell of their bounding boxes, and cells are joined
by equality; exact tests follow on what meets. Cells with very many points are ordinary skewed
join keys, which adaptive execution splits.

Points are rows with ``lon`` and ``lat``; polygons are rows with ``rings`` (outer ring first, then holes; a
ring is an array of [lon, lat]) and a position ``pos`` that says which of overlapping ones comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import degrees, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions.geo import DEGREE_M, EARTH_M, contains, haversine_m, let

from .order import numbered
from .shapes import inner_point

#: Degrees of a cell for polygons of some kilometres.
CELL = 0.02


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def bounds(rings: Column) -> list[Column]:
    """min and max of lon and lat of an outer ring."""
    outer = F.element_at(rings, 1)
    xs, ys = F.transform(outer, lambda p: p[0]), F.transform(outer, lambda p: p[1])
    return [F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)]


def inside(points: DataFrame, polygons: DataFrame, size: float = CELL, how: str = "all") -> DataFrame:
    """Points with the polygons they lie in.

    ``how``: ``all`` has a row for each pair (JOIN-6, JOIN-23) and none for points outside; ``first`` has each point
    once with the polygon of the smallest ``pos``, or nulls (JOIN-5); ``smallest`` likewise by ``area_km2``, then
    ``pos`` (JOIN-8). Points need a unique ``point_id`` for the last two. Points without a position are outside.
    """
    # cells get boxes and a ring key; the rings themselves come to what lies in a box, once for each polygon
    x0, x1, y0, y1 = bounds(F.col("rings"))
    shapes = polygons.withColumn("_ring", F.xxhash64("rings"))
    cells = shapes.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}).drop("rings")
    for axis, k in (("x", "ci"), ("y", "cj")):
        cells = cells.withColumn(k, F.explode(F.sequence(_cell(F.col(f"_{axis}0"), size), _cell(F.col(f"_{axis}1"), size))))
    spots = points.withColumn("ci", _cell(F.col("lon"), size)).withColumn("cj", _cell(F.col("lat"), size))
    pairs = spots.join(cells, ["ci", "cj"]).where("lon BETWEEN _x0 AND _x1 AND lat BETWEEN _y0 AND _y1")
    rings = shapes.groupBy("_ring").agg(F.first("rings").alias("rings"))
    pairs = pairs.join(rings, "_ring").where(contains(F.col("rings"), F.col("lon"), F.col("lat")))
    kept = [c for c in polygons.columns if c != "rings"]
    if how == "all":
        return pairs.select(*points.columns, *kept)
    order = F.struct("pos") if how == "first" else F.struct("area_km2", "pos")
    best = pairs.groupBy("point_id").agg(F.min_by(F.struct(*kept), order).alias("hit"))
    return points.join(best, "point_id", "left").select(*points.columns, "hit.*")


#: Candidate pairs of one task, and rows of one side that go to every task at most.
PAIRS_A_TASK = 4_000_000
MOST_BROADCAST = 2_000


def near(left: DataFrame, right: DataFrame, metres: float, within: Sequence[str] = ()) -> DataFrame:
    """Pairs within a distance, with ``metres`` (JOIN-2, JOIN-13); columns of the right side get the prefix ``r_``. With
    ``within`` only pairs that agree in these columns.

    Cells are as wide as the distance in latitude, and the side with fewer rows stands in all cells that the box around
    its circle meets, so that what is near always meets; boxes are compared before distances. Rows of the cells are
    counted first: there are as many tasks as the candidates ask for (``PAIRS_A_TASK``), and a cell with more of them is
    dealt to several. Latitudes beyond 60 degrees on the left are an error, and nothing is near across the 180th meridian.
    """
    # a little more than the distance, so that rounding loses nothing
    angle = metres / EARTH_M * 1.000001
    size = degrees(angle)
    left = left.withColumn("lat", F.when(F.abs("lat") > 60, F.raise_error(F.lit("latitudes beyond 60 degrees"))).otherwise(F.col("lat")))
    others = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    few, many = left.count(), right.count()
    wide = few <= many
    if min(few, many) <= MOST_BROADCAST:
        few_first = F.broadcast
        parts = 1 + max(few, many) * min(few, many) // (8 * PAIRS_A_TASK)
    else:
        few_first, parts = None, 0

    def spread(rows, x, y):
        across = F.when(F.abs(y) + size < 90, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians(y)))))).otherwise(360.0)
        rows = rows.withColumns({"_dlon": across, "_lon": x, "_lat": y})
        for c, v, d in (("ci", F.col("_lon"), F.col("_dlon")), ("cj", F.col("_lat"), F.lit(size))):
            rows = rows.withColumn(c, F.explode(F.sequence(_cell(v - d, size), _cell(v + d, size))))
        return rows

    place = lambda rows, x, y: rows.withColumns({"ci": _cell(x, size), "cj": _cell(y, size)})
    at, to = (F.col("lon"), F.col("lat")), (F.col("r_lon"), F.col("r_lat"))
    spots, others = (spread(left, *at), place(others, *to)) if wide else (place(left, *at), spread(others, *to))
    keys = [("ci", "_ci"), ("cj", "_cj"), *((c, f"r_{c}") for c in within)]
    others = others.withColumnsRenamed({"ci": "_ci", "cj": "_cj"})
    if few_first:
        big, small = (others, spots) if wide else (spots, others)
        if parts > 1:
            big = big.repartition(parts)
        spots, others = (few_first(small), big) if wide else (big, few_first(small))
    else:
        spots, others, keys = _dealt(spots, others, keys)
    pairs = spots.join(others if few_first else others.hint("merge"), [spots[c] == others[r] for c, r in keys])
    alone = F.col("r_lon" if wide else "lon"), F.col("r_lat" if wide else "lat")
    # without ends that rounding could move
    pairs = pairs.where((F.abs(alone[1] - F.col("_lat")) <= size) & (F.abs(alone[0] - F.col("_lon")) <= F.col("_dlon") * 1.000001))
    pairs = pairs.select(*left.columns, *[f"r_{c}" for c in right.columns])
    pairs = pairs.withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return pairs.where(F.col("metres") <= metres)


def _dealt(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Both sides of a join by ``keys`` in as many parts as their pairs ask for; a key with more of them is several."""
    ours, theirs = [k for k, _ in keys], [k for _, k in keys]
    of = lambda rows, names, n: rows.where(F.col("ci" if n == "_n" else "_ci").isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias(n))
    a, b = of(left, ours, "_n"), of(right, theirs, "_m")
    work = a.join(b.hint("merge"), [a[x] == b[y] for x, y in keys]).select(*ours, "_n", "_m")
    told = work.agg(F.sum(F.col("_n") * F.col("_m")), F.sum(F.col("_n") + F.col("_m")), F.max(F.col("_n") * F.col("_m"))).first()
    parts = 1 + int(max((told[0] or 0) // PAIRS_A_TASK, (told[1] or 0) // 250_000))
    names = list(keys)
    if (told[2] or 0) > PAIRS_A_TASK:
        # of a heavy key the left rows are dealt out, and the right ones go to each deal
        heavy = work.where(F.col("_n") * F.col("_m") > PAIRS_A_TASK).select(*[F.col(x).alias(f"_h{k}") for k, x in enumerate(ours)], F.least(F.ceil(F.col("_n") * F.col("_m") / PAIRS_A_TASK), F.col("_n")).cast("int").alias("_deals"))
        deals = lambda rows, cols: rows.join(heavy, [rows[c] == heavy[f"_h{k}"] for k, c in enumerate(cols)], "left").withColumn("_deals", F.coalesce("_deals", F.lit(1))).drop(*[f"_h{k}" for k in range(len(cols))])
        left = deals(left, ours).withColumn("_deal", F.pmod(F.xxhash64("lon", "lat", *[c for c in left.columns if c == "point_id" or c == "place_id"]), F.col("_deals")).cast("int")).drop("_deals")
        right = deals(right, theirs).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")
        names += [("_deal", "_to")]
    return left.repartition(parts, *[x for x, _ in names]), right.repartition(parts, *[y for _, y in names]), names


def _halvings(spots: DataFrame, reach: float, within: Sequence[str]) -> int:
    """How often a reach can be halved until a row's square of that size holds about two rows."""
    times = 0
    for _ in range(4):
        size = reach / 2**times / DEGREE_M
        n = spots.groupBy(*within, _cell(F.col("lon"), size), _cell(F.col("lat"), size)).agg(F.count(F.lit(1)).alias("n"))
        mean = n.agg(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        if mean <= 4 or times >= 24:
            break
        times += max(1, round(log2(mean / 2) / 2))
    return times


def nearest(left: DataFrame, right: DataFrame, reach_m: float, rounds: int = 12, within: Sequence[str] = (), other: bool = False) -> DataFrame:
    """Each left point (``point_id``) with the nearest right one and its distance, ties by ``point_id`` (JOIN-9, 10, 11).

    Rings grow: points without a neighbour in reach look twice as far in the next round, so the work follows the
    density of the right side. The last of ``rounds`` doublings of ``reach_m`` (half the globe from 5 km) caps the distance; the
    rest has none. Where the right side is dense, the first reaches are smaller by halves: what a point meets in a round doesn't
    grow with the table. With ``within`` only points that agree in these columns count, with ``other`` only those with another id.
    Rounds are checkpointed.
    """
    # of rows at one place only the first can be nearest, or the second to the first itself
    here = Window.partitionBy("lon", "lat", *within).orderBy("point_id")
    spots = right.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("_k", F.row_number().over(here)).where(f"_k <= {2 if other else 1}").select("point_id", "lon", "lat", *within).checkpoint()
    smaller = _halvings(spots, reach_m, within)
    todo, out, reach, last = left.select("point_id", "lon", "lat", *within), None, reach_m / 2**smaller, rounds + smaller
    for k in range(last):
        pairs = near(todo, spots, reach, within)
        pairs = pairs.where("point_id <> r_point_id") if other else pairs
        best = pairs.groupBy("point_id").agg(F.min_by(F.struct(F.col("r_point_id").alias("nearest_id"), "metres"), F.struct("metres", "r_point_id")).alias("best"))
        found = best.select("point_id", "best.nearest_id", "best.metres")
        if k + 1 < last:
            found = found.checkpoint()
        out = found if out is None else out.union(found)
        if k + 1 < last:
            todo = todo.join(found.select("point_id"), "point_id", "left_anti").checkpoint()
            if todo.isEmpty():
                break
            reach *= 2
    return left.join(out, "point_id", "left")


def _strip_counts(points: pd.DataFrame, things: pd.DataFrame, metres: float, strip: float) -> pd.DataFrame:
    """How many things of each kind lie near each point, of strips of latitude in which things are sorted by longitude.

    In a strip a circle's half width lies between two bounds: what is nearer than the smaller one is counted by its places
    in the order, what lies between both is measured.
    """
    if points.empty or things.empty:
        return pd.DataFrame({"point_id": [], "_kind": [], "n": []})
    lon, lat = points["lon"].to_numpy(), np.radians(points["lat"].to_numpy())
    reach = np.sin(metres / EARTH_M / 2) ** 2
    names, kinds = np.unique(things["_kind"].to_numpy(), return_inverse=True)
    x, y = things["lon"].to_numpy(), things["lat"].to_numpy()
    row = np.floor(y / strip).astype(np.int64)
    order = np.lexsort((x, kinds, row))
    x, y, row, kinds = x[order], np.radians(y[order]), row[order], kinds[order]
    total = np.zeros((len(names), len(lon)), np.int64)
    half = lambda h: np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(row)]):
        low, high = y[s:e].min(), y[s:e].max()
        off = np.maximum(np.maximum(low - lat, lat - high), 0.0)
        far = np.maximum(np.abs(lat - low), np.abs(lat - high))
        cosines = np.cos(np.array([low, high]))
        some, all_ = reach * (1 + 1e-9) - np.sin(off / 2) ** 2, reach * (1 - 1e-9) - np.sin(far / 2) ** 2
        at = np.flatnonzero(some >= 0)
        if not len(at):
            continue
        own = np.cos(lat[at])
        # between the strip's ends cosines may be larger than at both, if it holds the equator
        outer = half(some[at] / (own * cosines.min())) * (1 + 1e-9) + 1e-9
        inner = half(all_[at] / (own * (1.0 if low <= 0 <= high else cosines.max()))) * (1 - 1e-9) - 1e-9
        sure = (all_[at] > 0) & (inner > 0)
        for k in np.unique(kinds[s:e]):
            p, q = np.searchsorted(kinds[s:e], [k, k + 1]) + s
            xs = x[p:q]
            a, d = np.searchsorted(xs, lon[at] - outer), np.searchsorted(xs, lon[at] + outer, "right")
            b = np.where(sure, np.searchsorted(xs, lon[at] - inner), d)
            c = np.where(sure, np.searchsorted(xs, lon[at] + inner, "right"), d)
            total[k, at] += c - b
            first, n = np.concatenate([a, c]), np.concatenate([b - a, d - c])
            who = np.repeat(np.concatenate([at, at]), n)
            what = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n) + p
            h = np.sin((y[what] - lat[who]) / 2) ** 2 + np.cos(lat[who]) * np.cos(y[what]) * np.sin(np.radians(x[what] - lon[who]) / 2) ** 2
            near_ = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= metres
            total[k] += np.bincount(who[near_], minlength=len(lon))
    k, i = np.nonzero(total)
    return pd.DataFrame({"point_id": points["point_id"].to_numpy()[i], "_kind": names[k], "n": total[k, i]})


def counts_within(points: DataFrame, things: DataFrame, metres: float, kind: str = "kind") -> DataFrame:
    """How many things of each kind lie within a distance of each point (JOIN-13).

    Pairs are not listed: tiles of points meet bands of the things around them, and in a band things are counted by
    strips of latitude, of which only the ends are measured. Strips are the lower the denser things are, so the work for a
    point grows with the square root of what is near it; bands are so low, and points of a tile dealt out so often, that no
    task holds many. Latitudes and the 180th meridian as in ``near``.
    """
    angle = metres / EARTH_M * 1.000001
    size = degrees(angle)
    points = points.select("point_id", (F.col("lon") + 0.0).alias("lon"), F.when(F.abs("lat") > 60, F.raise_error(F.lit("latitudes beyond 60 degrees"))).otherwise(F.col("lat")).alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    # Python sees numbers of kinds
    things = things.select("lon", "lat", F.col(kind).alias("_name")).where("lon IS NOT NULL AND lat IS NOT NULL")
    kinds = things.select(F.col("_name").alias(kind)).distinct().withColumn("_kind", F.monotonically_increasing_id()).checkpoint()
    things = things.join(kinds, F.col("_name").eqNullSafe(F.col(kind))).select((F.col("lon") + 0.0).alias("lon"), (F.col("lat") + 0.0).alias("lat"), "_kind")
    tile = size / 2
    tiles = [_cell(F.col("lon"), tile), _cell(F.col("lat"), tile)]
    told = lambda rows: rows.groupBy(*tiles).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).first()
    most, _, _ = told(points)
    _, n, mean = told(things)
    dense = 4 * (mean or 0.0)
    bands = max(2, round(dense / 40_000))
    band = size / bands
    strip = band / max(1, round(dense**0.5 / 2 / bands))
    deals = 1 + (most or 0) // 50_000
    keys = ["_ti", "_tj", "_band", "_deal"]
    sequence = lambda low, high, of: F.explode(F.sequence(_cell(low, of), _cell(high, of)))
    at = points.withColumns({"_ti": tiles[0], "_tj": tiles[1], "_deal": F.pmod(F.xxhash64("point_id"), F.lit(deals)).cast("int")})
    at = at.withColumn("_band", sequence(F.col("lat") - size, F.col("lat") + size, band))
    wide = F.when(F.abs("lat") + size < 90, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians("lat")))))).otherwise(360.0)
    to = things.withColumn("_band", _cell(F.col("lat"), band)).withColumn("_ti", sequence(F.col("lon") - wide, F.col("lon") + wide, tile))
    to = to.withColumn("_tj", sequence(F.col("lat") - size, F.col("lat") + size, tile)).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    parts = 1 + (n or 0) * 36 * deals // 250_000
    both = at.repartition(parts, *keys).groupBy(*keys).cogroup(to.repartition(parts, *keys).groupBy(*keys))
    found = both.applyInPandas(lambda a, b: _strip_counts(a, b, metres, strip), f"point_id {points.schema['point_id'].dataType.simpleString()}, _kind long, n long")
    return found.groupBy("point_id", "_kind").agg(F.sum("n").alias("n")).join(kinds, "_kind").select("point_id", kind, "n")


def adjacent(polygons: DataFrame, pad: float = 0.004, size: float = CELL) -> DataFrame:
    """Pairs (a, b), a < b, of polygons (``key``) whose padded bounding boxes overlap (JOIN-20)."""
    x0, x1, y0, y1 = bounds(F.col("rings"))
    boxes = polygons.select("key", (x0 - pad).alias("x0"), (x1 + pad).alias("x1"), (y0 - pad).alias("y0"), (y1 + pad).alias("y1"))
    cells = boxes.withColumn("ci", F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size)))).withColumn("cj", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size))))
    other = cells.select("ci", "cj", *[F.col(c).alias(f"b_{c}") for c in boxes.columns])
    meet = (F.col("x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("x1")) & (F.col("y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("y1"))
    return cells.join(other, ["ci", "cj"]).where((F.col("key") < F.col("b_key")) & meet).select(F.col("key").alias("a"), F.col("b_key").alias("b")).distinct()


def snapped(points: DataFrame, polygons: DataFrame, cap_m: float = 3000.0) -> DataFrame:
    """Polygons for points that lie in none (JOIN-12), by the first rule that gives one:

    1 the polygon that contains the point, 2 the one its names (``name``, ``parent``) tell, 3 the one its name tells
    if no other has that name, 4 the one whose centre (``clon``, ``clat``) is nearest within ``cap_m``, for named points.
    Returns ``point_id``, ``key``, ``rule``; points that no rule places are missing.
    """
    contained = inside(points.select("point_id", "lon", "lat"), polygons.select("key", "pos", "rings"), how="first").where("key IS NOT NULL").select("point_id", "key", F.lit(1).alias("rule"), F.lit(0.0).alias("d"))
    names = polygons.select("key", F.col("name").alias("p_name"), F.col("parent").alias("p_parent"))
    by_both = points.join(names, (F.col("name") == F.col("p_name")) & (F.col("parent") == F.col("p_parent"))).select("point_id", "key", F.lit(2).alias("rule"), F.lit(0.0).alias("d"))
    unique = names.groupBy("p_name").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).where("n = 1")
    by_name = points.join(unique, F.col("name") == F.col("p_name")).select("point_id", "key", F.lit(3).alias("rule"), F.lit(0.0).alias("d"))
    best = lambda rows: rows.groupBy("point_id").agg(F.min_by(F.struct("key", "rule"), F.struct("rule", "d", "key")).alias("best")).select("point_id", "best.*")
    told = best(contained.union(by_both).union(by_name)).checkpoint()
    # only points that nothing else places look for centres
    centres = polygons.select(F.col("key"), F.col("clon").alias("lon"), F.col("clat").alias("lat"))
    rest = points.where("name IS NOT NULL").select("point_id", "lon", "lat").join(told, "point_id", "left_anti")
    close = near(rest, centres, cap_m).select("point_id", F.col("r_key").alias("key"), F.lit(4).alias("rule"), F.col("metres").alias("d"))
    return told.union(best(close))


def lattice(polygons: DataFrame, n: int = 50) -> DataFrame:
    """The centres of an n by n lattice over each polygon's bounding box, those inside only."""
    x0, x1, y0, y1 = bounds(F.col("rings"))
    grid = polygons.select("key", "rings", x0.alias("x0"), ((x1 - x0) / n).alias("w"), y0.alias("y0"), ((y1 - y0) / n).alias("h"))
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    spots = grid.select("key", "rings", (F.col("x0") + (F.col("i") + 0.5) * F.col("w")).alias("lon"), (F.col("y0") + (F.col("j") + 0.5) * F.col("h")).alias("lat"))
    return spots.where(contains(F.col("rings"), F.col("lon"), F.col("lat"))).drop("rings")


def overlap_shares(polygons: DataFrame, covers: DataFrame, n: int = 50, least: float = 0.005) -> DataFrame:
    """What share of each polygon each cover holds, by lattice points (JOIN-21); small shares are left out."""
    spots = lattice(polygons, n)
    totals = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n_all"))
    both = inside(spots, covers.select(F.col("key").alias("cover"), "rings")).groupBy("key", "cover").agg(F.count(F.lit(1)).alias("n_in"))
    return both.join(totals, "key").where(F.col("n_in") >= least * F.col("n_all")).select("key", "cover", "n_in", "n_all")


#: Scanlines of a row, and pairs of a circle and a polygon of a task.
LINES = 64
CIRCLES_A_TASK = 1_000


def scan_counts(circles: DataFrame, polygons: DataFrame, metres: float, step: float = 100.0) -> DataFrame:
    """For each circle and polygon that may meet: samples inside the polygon, and those also in the circle (GEO-16).

    Samples stand in rows ``step`` metres apart, from the polygon's lowest point up, on a local projection around the
    circle's centre. They are counted, not listed: a row crosses the polygon's sides at sorted places, between which it
    is in and out by turns, and the circle leaves a chord of it. Holes and several parts count as they should. Rows
    are dealt out ``LINES`` at a time, so a large polygon is many rows.

    ``circles``: point_id, lon, lat; ``polygons``: key, rings. Columns: point_id, key, n_in, n_hit.
    """
    size = metres / 110574.0
    x0, x1, y0, y1 = bounds(F.col("rings"))
    boxes = polygons.select("key", x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1"))
    spread = lambda rows, axis, a, b: rows.withColumn(axis, F.explode(F.sequence(_cell(a, size), _cell(b, size))))
    cells = spread(spread(boxes, "ci", F.col("_x0"), F.col("_x1")), "cj", F.col("_y0"), F.col("_y1"))
    dlat, dlon = F.lit(size), metres / (111320.0 * F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    spots = circles.select("point_id", "lon", "lat", dlon.alias("dlon"))
    spots = spread(spread(spots, "ci", F.col("lon") - F.col("dlon"), F.col("lon") + F.col("dlon")), "cj", F.col("lat") - dlat, F.col("lat") + dlat)
    near_ = (F.col("_x0") <= F.col("lon") + F.col("dlon")) & (F.col("_x1") >= F.col("lon") - F.col("dlon")) & (F.col("_y0") <= F.col("lat") + dlat) & (F.col("_y1") >= F.col("lat") - dlat)
    pairs = spots.join(cells, ["ci", "cj"]).where(near_).select("point_id", "lon", "lat", "key").distinct().checkpoint()
    # scanlines are much work for few bytes, so their tasks follow the number of pairs
    pairs = pairs.repartition(1 + pairs.count() // CIRCLES_A_TASK)
    k = F.cos(F.radians("lat"))
    flat = lambda p: F.array(F.radians(p[0] - F.col("lon")) * EARTH_M * k, F.radians(p[1] - F.col("lat")) * EARTH_M)
    rows = pairs.join(polygons.select("key", "rings"), "key").withColumn("r", F.transform("rings", lambda r: F.transform(r, flat))).drop("rings")
    ys = F.flatten(F.transform("r", lambda r: F.transform(r, lambda p: p[1])))
    rows = rows.withColumns({"low": F.array_min(ys), "high": F.array_max(ys)}).where("high > low")
    lines = F.greatest(F.ceil((F.col("high") - F.col("low")) / step - 0.5), F.lit(0)).cast("int")
    rows = rows.withColumn("lines", lines).where("lines > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("lines") - 1, F.lit(LINES))))

    def crossings(y):
        def of(ring):
            following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
            hit = lambda a, b: F.when((a[1] > y) != (b[1] > y), a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]))
            return F.filter(F.zip_with(ring, following, hit), lambda x: x.isNotNull())

        return F.array_sort(F.flatten(F.transform("r", of)))

    # the sample with number n stands at (n + 0.5) * step
    least, most = lambda x: F.ceil(x / step - 0.5), lambda x: F.floor(x / step - 0.5)

    def counts(xs, chord):
        spans = F.transform(F.sequence(F.lit(1), F.floor(F.size(xs) / 2).cast("int")), lambda i: F.named_struct(F.lit("a"), least(F.element_at(xs, 2 * i - 1)), F.lit("b"), least(F.element_at(xs, 2 * i)) - 1))
        total = lambda n: F.aggregate(F.when(F.size(xs) > 1, spans).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")), F.lit(0).cast("long"), lambda s, t: s + F.greatest(n(t), F.lit(0).cast("long")))
        cut = lambda t: F.least(t["b"], most(chord)) - F.greatest(t["a"], least(-chord)) + 1
        return F.named_struct(F.lit("n_in"), total(lambda t: t["b"] - t["a"] + 1), F.lit("n_hit"), F.when(chord.isNotNull(), total(cut)).otherwise(F.lit(0).cast("long")))

    height = lambda i: F.col("low") + (i + 0.5) * step
    chord = lambda y: F.when(y * y <= metres * metres, F.sqrt(metres * metres - y * y))
    each = F.transform(F.sequence("first", F.least(F.col("lines"), F.col("first") + LINES) - 1), lambda i: let(height(i), lambda y: let(crossings(y), lambda xs: counts(xs, chord(y)))))
    both = rows.select("point_id", "key", each.alias("c"))
    total = lambda name: F.sum(F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + c[name])).alias(name)
    return both.groupBy("point_id", "key").agg(total("n_in"), total("n_hit")).where("n_in > 0")


def catchments(circles: DataFrame, polygons: DataFrame, metres: float, step: float = 100.0) -> DataFrame:
    """What lies within a distance of points (JOIN-22): ``population``, spread evenly over each polygon, ``area_km2``, and how many
    polygons are in it (``n_whole``) or cut (``n_partial``). Polygons of unknown population count as ground only."""
    shares = scan_counts(circles, polygons, metres, step).where("n_hit > 0").join(polygons.select("key", "population"), "key")
    share = F.col("n_hit") / F.col("n_in")
    people = F.coalesce(F.sum(F.col("population") * share), F.lit(0.0)).alias("population")
    area = (F.sum("n_hit") * step * step / 1e6).alias("area_km2")
    return shares.groupBy("point_id").agg(people, area, F.count_if(share >= 0.999).alias("n_whole"), F.count_if(share < 0.999).alias("n_partial"))


def named_catchments(districts: DataFrame, polygons: DataFrame, metres: float = 10_000.0, step: float = 100.0) -> DataFrame:
    """The catchments around districts (SCR-7): ``districts`` have ``name`` and ``rings``, and a centre inside their ground."""
    centres = districts.select(F.col("name").alias("point_id"), inner_point(F.col("rings")).alias("p")).select("point_id", "p.lon", "p.lat")
    return catchments(centres, polygons, metres, step).withColumnRenamed("point_id", "name")


def thinned(points: DataFrame, most: int, by: list[str]) -> DataFrame:
    """Every k-th point in an order, with the smallest k that leaves at most ``most`` (WIN-8).

    The columns of the order must tell the points apart.
    """
    stride = max(1, -(-points.count() // most))
    rows = numbered(points, [F.col(c) for c in by], "place").withColumn("place", F.col("place") - 1)
    return rows.where(F.pmod("place", F.lit(stride)) == 0).select(*points.columns, "place")
