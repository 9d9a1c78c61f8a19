"""Outlines put together from directed edges, by jumping along them (GEO-9, GEO-11, GEO-12).

Edges have what they enclose on their left. Each knows its successor: at a corner the first edge out, turning
clockwise from the edge in, so that outlines touch but don't run into each other. Then edges look ahead twice as far
in each round, until all of an outline know its least edge, and once more to count how many edges are left up to its end.
A round is a join by edge, whatever the outline or the owner, so neither is a group before a ring is put together.
Ids follow the edges' order, so that results are the same each time. Rounds end in tables in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions.geo import contains, let
from terrafold.session import written

from .lattice import absorbed, covered, hulls, overlap, owned
from .shapes import inner_point

_ENDS = ("x1", "y1", "x2", "y2")


def _with_successors(edges: DataFrame, group: str) -> DataFrame:
    """``edges`` with ``id`` and the id of the ``next`` edge; null where an edge leads nowhere."""
    order = [F.col(c).asc_nulls_first() for c in (group, *_ENDS)]
    rows = written(edges.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    # around a corner: edges in by the direction they come from, edges out by that they go to
    back, ahead = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    side = lambda x, y, out, angle: rows.select(F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y"), "id", F.lit(out).alias("out"), angle.alias("angle"))
    both = side("x2", "y2", False, back).union(side("x1", "y1", True, ahead))
    here = Window.partitionBy("_g", "_x", "_y")
    both = both.withColumn("k", F.row_number().over(here.partitionBy("_g", "_x", "_y", "out").orderBy(F.col("angle").desc(), "id")))
    first = lambda out: F.max(F.when(F.col("out") == out, F.col("angle"))).over(here)
    n_out = F.count_if("out").over(here)
    # no edge follows two others, so edges are closed rings and open lines only
    both = both.withColumn("to", F.when(F.col("k") <= n_out, F.when(first(True) < first(False), F.col("k")).otherwise(F.col("k") % n_out + 1)))
    into = both.where("NOT out").select("id", "_g", "_x", "_y", "to")
    out = both.where("out").select(F.col("id").alias("next"), F.col("_g").alias("g"), F.col("_x").alias("x"), F.col("_y").alias("y"), "k")
    met = into.join(out, F.col("_g").eqNullSafe(F.col("g")) & (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y")) & (F.col("to") == F.col("k"))).select(F.col("id").alias("_id"), "next")
    return written(rows.join(met, rows["id"] == met["_id"], "left").drop("_id"))


def _ahead(rows: DataFrame) -> DataFrame:
    """Each row with what its ``next`` row has, as ``_next`` and so on."""
    other = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    return rows.join(other, rows["next"] == other["_id"], "left")


def _least(edges: DataFrame) -> DataFrame:
    """(id, ring) of the edges on closed outlines; ``ring`` is the least id of an outline."""
    rows = edges.select("id", "next", F.col("id").alias("ring"))
    while True:
        rows = rows.select("*", F.col("ring").alias("before"), F.col("next").isNotNull().alias("went"))
        for _ in range(2):
            rows = _ahead(rows).select("id", F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring"), "before", "went")
        rows = written(rows)
        if not rows.where("ring < before OR went AND next IS NULL").limit(1).count():
            return rows.where("next IS NOT NULL").select("id", "ring")
        rows = rows.select("id", "next", "ring")


def _left(edges: DataFrame) -> DataFrame:
    """(id, left): how many edges follow up to the end of the ring, which begins with its least edge."""
    rows = edges.select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), (F.col("next") != F.col("ring")).cast("long").alias("left"))
    while rows.where("next IS NOT NULL").limit(1).count():
        for _ in range(2):
            rows = _ahead(rows).select("id", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0).cast("long"))).alias("left"))
        rows = written(rows)
    return rows.select("id", "left")


def rings(edges: DataFrame, group: str, carry: Sequence[str] = ()) -> DataFrame:
    """Closed outlines of directed edges (``group``, ``x1``, ``y1``, ``x2``, ``y2``): ``group``, ``ring`` and ``corners``, structs of
    ``x``, ``y`` and what is carried of the edge that leaves the corner.

    A ring begins with its least corner; numbers of rings grow with it. Edges that close nothing are left out.
    """
    linked = _with_successors(edges.select(group, *_ENDS, *carry), group)
    least = _least(linked).withColumnRenamed("id", "_id")
    linked = written(linked.join(least, linked["id"] == least["_id"]).drop("_id"))
    left = _left(linked).withColumnRenamed("id", "_id")
    corner = F.struct((-F.col("left")).alias("at"), F.col("x1").alias("x"), F.col("y1").alias("y"), *carry)
    found = linked.join(left, linked["id"] == left["_id"]).groupBy(group, "ring").agg(F.array_sort(F.collect_list(corner)).alias("c"))
    return found.select(group, "ring", F.transform("c", lambda p: p.dropFields("at")).alias("corners"))


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a ring of structs: positive to the left around."""
    cross = lambda r: F.zip_with(r, _turned(r, 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(let(ring, cross), F.lit(0).cast("double"), lambda s, v: s + v)


def _spots(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))


def _around(found: DataFrame, group: str) -> DataFrame:
    """Each hole's smallest outer ring around it: (hole, outer), both ``ring`` numbers.

    Outer rings stand in the one to four squares of their own size that their boxes meet, holes in one square of each
    size from their own on; so a ring is never many rows, and a hole meets what is around it only.
    """
    xs, ys = F.transform("corners", lambda p: p["x"]), F.transform("corners", lambda p: p["y"])
    boxes = found.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    boxes = boxes.withColumn("level", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("double"))).cast("int"))
    outer = boxes.where("area > 0").select(group, "ring", "area", "corners", "x0", "x1", "y0", "y1", "level")
    place = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level)).cast("long")
    for axis in ("x", "y"):
        outer = outer.withColumn(f"c{axis}", F.explode(F.sequence(place(F.col(f"{axis}0"), F.col("level")), place(F.col(f"{axis}1"), F.col("level")))))
    highest = boxes.agg(F.max("level")).first()[0] or 0
    holes = boxes.where("area < 0").select(F.col(group).alias("_g"), F.col("ring").alias("hole"), F.abs("area").alias("size"), "level", inner_point(F.array(_spots(F.col("corners")))).alias("p"))
    holes = holes.select("_g", "hole", "size", "p", F.explode(F.sequence("level", F.lit(highest))).alias("_level"))
    holes = holes.withColumns({"_cx": place(F.col("p.lon"), F.col("_level")), "_cy": place(F.col("p.lat"), F.col("_level"))})
    near = holes.join(outer, F.col("_g").eqNullSafe(F.col(group)) & (F.col("_level") == F.col("level")) & (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy")))
    inside = near.where("area > size").where(contains(F.array(_spots(F.col("corners"))), F.col("p.lon"), F.col("p.lat")))
    return written(inside.groupBy("hole").agg(F.min_by("ring", F.struct("area", "ring")).alias("outer")))


def nested(found: DataFrame, group: str) -> DataFrame:
    """Parts of each group from ``rings`` with their ``points``: an outer ring and its holes, parts from 1, the largest first.

    A hole belongs to the smallest outer ring around it.
    """
    found = written(found.withColumn("area", twice_area(F.col("corners"))))
    owner = _around(found, group)
    placed = found.join(owner, found["ring"] == owner["hole"], "left").withColumn("of", F.when(F.col("area") > 0, F.col("ring")).otherwise(F.col("outer"))).where("of IS NOT NULL")
    parts = placed.groupBy(group, "of").agg(F.max("area").alias("area"), F.array_sort(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), "ring", "points"))).alias("r"))
    number = F.row_number().over(Window.partitionBy(group).orderBy(F.col("area").desc(), "of"))
    return parts.select(group, number.alias("part"), F.transform("r", lambda r: r["points"]).alias("rings"))


def directed(polygons: DataFrame, group: str) -> DataFrame:
    """Edges that only one polygon of a group has, ends in whole ten-millionths, with the group's ground on their left.

    However the rings of a polygon are wound: one that an even number of the polygon's larger rings hold is turned to the
    left, others to the right.
    """
    area = lambda r: twice_area(F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    told = F.transform(F.filter("rings", lambda r: F.size(r) > 2), lambda r: F.struct(r.alias("r"), area(r).alias("a"), inner_point(F.array(r)).alias("p")))
    rows = polygons.select(F.col(group), told.alias("t")).select(group, "t", F.explode("t").alias("own"))
    depth = F.size(F.filter("t", lambda o: (F.abs(o["a"]) > F.abs(F.col("own.a"))) & contains(F.array(o["r"]), F.col("own.p.lon"), F.col("own.p.lat"))))
    right = (F.col("own.a") > 0) == (depth % 2 == 0)
    point = lambda p: F.struct(F.floor(p[0] * 1e7 + 0.5).cast("long").alias("x"), F.floor(p[1] * 1e7 + 0.5).cast("long").alias("y"))
    rows = rows.select(group, F.transform(F.when(right, F.col("own.r")).otherwise(F.reverse("own.r")), point).alias("r"))
    following = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    ends = rows.select(group, F.explode(F.arrays_zip(F.col("r").alias("p"), following.alias("q"))).alias("e")).select(group, "e.p", "e.q").where("p <> q")
    ends = ends.select(group, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), (F.col("p") < F.col("q")).alias("ahead"))
    once = ends.groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("ahead").alias("ahead")).where("n = 1")
    end = lambda x, y, c: F.when(F.col("ahead"), F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return once.select(group, end("a", "b", "x").alias("x1"), end("a", "b", "y").alias("y1"), end("b", "a", "x").alias("x2"), end("b", "a", "y").alias("y2"))


def dissolved(polygons: DataFrame, group: str) -> DataFrame:
    """The union of each group's polygons (GEO-12): ``part`` and ``rings``, outer ones to the left, holes to the right.

    Shared edges cancel in a shuffle, the rest is put together by ``rings``.
    """
    found = rings(directed(polygons, group), group)
    points = F.transform("corners", lambda p: F.array(p["x"] / 1e7, p["y"] / 1e7))
    return nested(found.withColumn("points", points), group)


def cell_edges(cells: DataFrame, exclusive: bool = True) -> DataFrame:
    """The borders of each owner's cells: ``owner``, ends, and whether the other side is ``free``.

    Where ownership is exclusive, a side between two owners is an edge of both, a seam; else owners don't see each other.
    """
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    side = lambda name, x, y, upright, left: F.struct(F.lit(name).alias("side"), x.alias("x"), y.alias("y"), F.lit(upright).alias("upright"), F.lit(left).alias("left"))
    sides = F.array(side("b", i, j, False, True), side("t", i, j + 1, False, False), side("r", i + 1, j, True, True), side("l", i, j, True, False))
    each = cells.select("owner", F.explode(sides).alias("s")).select("owner", "s.*")
    keys = ["x", "y", "upright", *([] if exclusive else ["owner"])]
    # an edge has its ground on the left of its way: to the right along a cell's lower side, upwards along its right one
    at = lambda left: F.max_by("owner", F.when(F.col("left") == left, F.lit(1)))
    has = lambda left: F.max((F.col("left") == left))
    both = each.groupBy(*keys).agg(at(True).alias("lo"), at(False).alias("ro"), has(True).alias("hl"), has(False).alias("hr")) if exclusive else each.groupBy(*keys).agg(has(True).alias("hl"), has(False).alias("hr")).withColumns({"lo": F.col("owner"), "ro": F.col("owner")}).drop("owner")
    both = both.where(~(F.col("hl") & F.col("hr") & F.col("lo").eqNullSafe(F.col("ro"))))
    far = (F.col("x") + F.when(F.col("upright"), 0).otherwise(1), F.col("y") + F.when(F.col("upright"), 1).otherwise(0))
    free = ~(F.col("hl") & F.col("hr"))
    one = both.where("hl").select(F.col("lo").alias("owner"), F.col("x").alias("x1"), F.col("y").alias("y1"), far[0].alias("x2"), far[1].alias("y2"), free.alias("free"))
    other = both.where("hr").select(F.col("ro").alias("owner"), far[0].alias("x1"), far[1].alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), free.alias("free"))
    return one.union(other)


def _turned(ring: Column, by: int) -> Column:
    """The ring from another corner on: the following one (1) or the one before (-1)."""
    if by > 0:
        return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))


def _trio(ring: Column) -> Column:
    """Each corner with the one before and the one after."""
    return F.arrays_zip(_turned(ring, -1).alias("a"), ring.alias("b"), _turned(ring, 1).alias("c"))


def straightened(ring: Column) -> Column:
    """Without corners on straight runs, unless the edges beside them differ in ``free`` or the corner is a ``node``."""
    straight = lambda t: ((t["b"]["x"] - t["a"]["x"]) * (t["c"]["y"] - t["b"]["y"]) == (t["b"]["y"] - t["a"]["y"]) * (t["c"]["x"] - t["b"]["x"])) & (t["a"]["free"] == t["b"]["free"]) & ~t["b"]["node"]
    return let(ring, lambda r: F.transform(F.filter(_trio(r), lambda t: ~straight(t)), lambda t: t["b"]))


def _between(t: Column, share: float, node: bool = False) -> Column:
    mid = lambda c: t["b"][c] * (1 - share) + t["c"][c] * share
    return F.struct(mid("x").alias("x"), mid("y").alias("y"), t["b"]["free"].alias("free"), F.lit(node).alias("node"))


def smoothed(ring: Column, rounds: int, seams: bool) -> Column:
    """Corners cut at a quarter and three quarters of the edges beside them, some rounds.

    Without ``seams`` only corners between two free edges are cut, so that a seam stays where the cells have it. With
    them all but nodes are, where more than two borders meet: both owners of a seam cut it alike, from either end.
    """
    for _ in range(rounds):
        if seams:
            cut = lambda t: F.when(t["b"]["node"], F.array(t["b"], _between(t, 0.25), _between(t, 0.75))).otherwise(F.array(_between(t, 0.25), _between(t, 0.75)))
        else:
            some = lambda t: F.when(t["b"]["free"], F.array(t["b"], _between(t, 0.75))).otherwise(F.array(t["b"]))
            cut = lambda t: F.when(t["a"]["free"] & t["b"]["free"], F.array(_between(t, 0.25), _between(t, 0.75))).otherwise(some(t))  # noqa: E731, B023
        ring = let(ring, lambda r: F.flatten(F.transform(_trio(r), cut)))  # noqa: B023
    return ring


def outlines(cells: DataFrame, cell: float, rounds: int = 0, exclusive: bool = True, seams: bool = False) -> DataFrame:
    """Outlines of each owner's cells in metres (GEO-9): ``owner``, ``ring`` (from 0), ``is_hole``, ``points``.

    Cells are different rows, with one owner each if ``exclusive``. ``seams`` as in ``smoothed``. A cell's corners are
    whole numbers, and points are computed alike from both sides, so neighbours share them to the last bit.
    """
    edges = cell_edges(cells, exclusive)
    if seams:
        # an edge between two owners is there once from either side
        borders = edges.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"), F.when(F.col("free"), 2).otherwise(1).alias("n"))
        nodes = borders.groupBy("p.x", "p.y").agg(F.sum("n").alias("n")).where("n > 4").select("x", "y", F.lit(True).alias("node"))
        edges = edges.join(nodes, (F.col("x1") == F.col("x")) & (F.col("y1") == F.col("y")), "left").drop("x", "y").withColumn("node", F.coalesce("node", F.lit(False)))
    else:
        edges = edges.withColumn("node", F.lit(False))
    found = rings(edges, "owner", ["free", "node"])
    exact = F.transform("corners", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), p["free"].alias("free"), p["node"].alias("node")))
    found = found.withColumn("area", twice_area(F.col("corners"))).withColumn("corners", smoothed(straightened(exact), rounds, seams))
    number = (F.row_number().over(Window.partitionBy("owner").orderBy("ring")) - 1).cast("int")
    return found.select("owner", number.alias("ring"), (F.col("area") < 0).alias("is_hole"), F.transform("corners", lambda p: F.array(p["x"] * cell, p["y"] * cell)).alias("points"))


def territories(points: DataFrame, mode: str, cell: float = 500.0, reach: float = 1000.0, rounds: int = 2, least: int = 3, seams: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Territories of owners' points (GEO-11): features, skipped owners, and how much they overlap.

    ``mode``: ``coverage`` (all cells that an owner's points reach), ``exclusive`` (cells of the nearest point, islands given
    away) or ``hull``. Features have ``owner``, ``n_points``, ``n_parts``, ``area_m2`` and ``parts``, each a list of rings. Owners of fewer
    than ``least`` points, or without a shape, are ``skipped``, with ``n_points``; their cells still bound the others'. Nothing
    overlaps in ``exclusive`` mode; hulls have no cells, so nothing is told of them.
    """
    counts = points.groupBy("owner").agg(F.count(F.lit(1)).alias("n_points"))
    some = counts.where(F.col("n_points") >= least)
    if mode == "hull":
        shapes = hulls(points, least).withColumn("rings", F.array("ring")).withColumn("part", F.lit(1)).select("owner", "part", "rings")
        overlaps = None
    elif mode in ("coverage", "exclusive"):
        cells = covered(points, cell, reach) if mode == "coverage" else absorbed(owned(points, cell, reach))
        kept = lambda rows: rows.join(some.select(F.col("owner").alias("_o")), F.col("owner").eqNullSafe(F.col("_o")), "left_semi")
        lines = kept(outlines(cells, cell, rounds, mode == "exclusive", seams))
        corners = F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        shapes = nested(lines.withColumn("ring", F.xxhash64("owner", "ring")).select("owner", "ring", corners.alias("corners"), "points"), "owner")
        overlaps = overlap(kept(cells))
    else:
        raise ValueError(f"unknown mode {mode}")
    flat = lambda r: twice_area(F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    area = F.abs(F.aggregate("rings", F.lit(0.0), lambda s, r: s + flat(r))) / 2
    found = shapes.withColumn("area", area).groupBy("owner").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("area").alias("area_m2"), F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("p"))
    found = found.select(F.col("owner").alias("_o"), "n_parts", "area_m2", F.transform("p", lambda p: p["rings"]).alias("parts"))
    both = counts.join(found, F.col("owner").eqNullSafe(F.col("_o")), "left").drop("_o")
    return both.where("parts IS NOT NULL"), both.where("parts IS NULL").select("owner", "n_points"), overlaps
