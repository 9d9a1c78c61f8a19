"""Territories on a lattice of square cells (GEO-6 to 12, SET-6, D8).

Points have ``owner``, ``x`` and ``y`` in metres; cells are (``i``, ``j``).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geo import haversine_m

from .resolve import clusters


#: Cells that the points of one task reach, about.
STAMPS_A_TASK = 1_000_000


def _stamps(points: DataFrame, cell: float, reach: float) -> DataFrame:
    """A row for each cell whose centre a point reaches, with the squared distance.

    Points are dealt out first, so that a task stamps and sorts as many cells however many points there are.
    """
    r = int(math.ceil(reach / cell))
    steps = F.sequence(F.lit(-r), F.lit(r))
    points = points.select("owner", "x", "y")
    parts = 1 + points.count() * (2 * r + 1) ** 2 // STAMPS_A_TASK
    at = points.repartition(parts) if parts > 1 else points
    at = at.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    at = at.withColumn("i", (F.floor(F.col("x") / cell) + F.col("di")).cast("int")).withColumn("j", (F.floor(F.col("y") / cell) + F.col("dj")).cast("int"))
    d2 = F.pow((F.col("i") + 0.5) * cell - F.col("x"), 2) + F.pow((F.col("j") + 0.5) * cell - F.col("y"), 2)
    return at.withColumn("d2", d2).where(F.col("d2") <= reach * reach).drop("di", "dj")


def covered(points: DataFrame, cell: float, reach: float) -> DataFrame:
    """Cells that each owner's points reach (GEO-6)."""
    return _stamps(points, cell, reach).select("owner", "i", "j").distinct()


def owned(points: DataFrame, cell: float, reach: float) -> DataFrame:
    """Cells with the owner of the nearest point, ties to the smallest owner (GEO-7): a pre-aggregated minimum."""
    return _stamps(points, cell, reach).groupBy("i", "j").agg(F.min_by("owner", F.struct("d2", "owner")).alias("owner"))


def overlap(cells: DataFrame) -> DataFrame:
    """Cells in all, distinct ones, and the share that several owners have (SET-6)."""
    each = cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("distinct_cells")).withColumn("overlap", 1 - F.col("distinct_cells") / F.col("cells"))


def absorbed(cells: DataFrame, least: int = 8) -> DataFrame:
    """Owned cells with islands of under ``least`` cells given to the neighbour they touch most (GEO-8)."""
    node = F.struct("i", "j")
    named = cells.select("owner", "i", "j", F.concat_ws(",", "i", "j").alias("node"))
    steps = [(1, 0), (0, 1)]
    other = named.select(F.col("owner").alias("o2"), F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("node").alias("n2"))
    pairs = None
    for di, dj in steps:
        hit = named.join(other, (F.col("i2") == F.col("i") + di) & (F.col("j2") == F.col("j") + dj))
        pairs = hit if pairs is None else pairs.union(hit)
    pairs = pairs.checkpoint()
    labels = clusters(named.select("node"), pairs.where("owner = o2").select(F.col("node").alias("a"), F.col("n2").alias("b")))
    small = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("cluster")
    islands = labels.join(small, "cluster").select("node", "cluster").checkpoint()
    touch = pairs.where("owner <> o2")
    touch = touch.select("node", F.col("o2").alias("host")).union(touch.select(F.col("n2").alias("node"), F.col("owner").alias("host")))
    hosts = touch.join(islands, "node").groupBy("cluster", "host").agg(F.count(F.lit(1)).alias("contacts")).groupBy("cluster").agg(F.min_by("host", F.struct(-F.col("contacts"), "host")).alias("host"))
    moved = islands.join(hosts, "cluster").select("node", "host")
    del node
    return named.join(moved, "node", "left").select(F.coalesce("host", "owner").alias("owner"), "i", "j")


def _half_hull(order: list[tuple[float, float]]) -> list[tuple[float, float]]:
    chain: list[tuple[float, float]] = []
    for p in order:
        while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
            chain.pop()
        chain.append(p)
    return chain[:-1]


def _hull(group: pd.DataFrame) -> list[tuple[float, float]]:
    spots = sorted(set(zip(group["x"].tolist(), group["y"].tolist())))
    return _half_hull(spots) + _half_hull(spots[::-1]) if len(spots) > 1 else spots


def corners(points: DataFrame, strip: float) -> DataFrame:
    """(owner, x, y): of each owner's points some few among which are all corners of its convex hull.

    Of points with one x only the lowest and the highest can be corners, and of those of a strip of the ground only
    the corners of the strip's hull.
    """
    ends = points.groupBy("owner", "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    spots = ends.select("owner", "x", F.explode(F.array_distinct(F.array("low", "high"))).alias("y"))
    kind = points.schema["owner"].dataType.simpleString()

    def of_strip(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group["owner"].iloc[0], *p) for p in _hull(group)], columns=["owner", "x", "y"])

    return spots.groupBy("owner", F.floor(F.col("x") / strip).alias("strip")).applyInPandas(lambda g: of_strip(g), f"owner {kind}, x double, y double")


def hulls(points: DataFrame, least: int = 3, strip: float = 1000.0) -> DataFrame:
    """Convex hulls of each owner's points, for owners with at least ``least`` different ones (GEO-10, GEO-11); points
    on one line have none. Made of the corners of strips."""
    enough = points.groupBy("owner", "x").agg(F.count_distinct("y").alias("n")).groupBy("owner").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("owner")
    kind = points.schema["owner"].dataType.simpleString()

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        found = _hull(group)
        return pd.DataFrame([(group["owner"].iloc[0], [list(p) for p in found])] if len(found) > 2 else [], columns=["owner", "ring"])

    return corners(points.join(enough, "owner", "left_semi"), strip).groupBy("owner").applyInPandas(whole, f"owner {kind}, ring array<array<double>>")


#: Points of an owner that are compared with each other where they are.
MOST_PAIRED = 64


def spans(points: DataFrame, strip: float = 0.01) -> DataFrame:
    """(owner, far_m): the distance between each owner's farthest two points (``x`` longitude, ``y`` latitude).

    Up to ``MOST_PAIRED`` different points are an array of one row, and all pairs of it an expression. Of more points
    only the corners of strips' hulls, then of the whole hull, are compared.
    """
    kind = points.schema["owner"].dataType.simpleString()
    spots = points.groupBy("owner", "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    counts = spots.groupBy("owner").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda test: spots.drop("_n").join(counts.where(test).drop("_n"), "owner", "left_semi")
    far = lambda p: F.array_max(F.transform("_all", lambda q: haversine_m(p["y"], p["x"], q["y"], q["x"])))
    few = of(F.col("_n") <= MOST_PAIRED).groupBy("owner").agg(F.collect_list(F.struct("x", "y")).alias("_all")).select("owner", F.array_max(F.transform("_all", far)).alias("far_m"))

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group["owner"].iloc[0], *p) for p in _hull(group)], columns=["owner", "x", "y"])

    rows = corners(of(F.col("_n") > MOST_PAIRED), strip).groupBy("owner").applyInPandas(whole, f"owner {kind}, x double, y double")
    pairs = rows.join(rows.select("owner", F.col("x").alias("u"), F.col("y").alias("v")), "owner")
    many = pairs.groupBy("owner").agg(F.max(haversine_m(F.col("y"), F.col("x"), F.col("v"), F.col("u"))).alias("far_m"))
    return few.union(many)


def outer_edges(polygons: DataFrame, group: str) -> DataFrame:
    """Edges that only one polygon of a group has: the outline of their union (GEO-12).

    Polygons have ``rings``; an edge counts without direction, its ends rounded to seven places.
    """
    ring = F.explode("rings")
    edges = polygons.select(group, ring.alias("r")).select(group, F.explode(F.arrays_zip(F.col("r").alias("p"), F.concat(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, 1)).alias("q"))).alias("e"))
    point = lambda p: F.struct(F.floor(p[0] * 1e7 + 0.5).cast("long").alias("x"), F.floor(p[1] * 1e7 + 0.5).cast("long").alias("y"))
    ends = edges.select(group, point(F.col("e.p")).alias("p"), point(F.col("e.q")).alias("q")).where("p <> q")
    ends = ends.select(group, F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return ends.groupBy(group, "p", "q").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(group, F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
