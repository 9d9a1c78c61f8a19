"""Queries over polygons, distances, lattices, scores and assignments (§2.4, 2.6, 2.8, 2.13 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import forcefit, lattice, outline, review, shapes, siting, spatial, territory

from .fixtures import IN_BOX, METRES, frame, polygons, with_
from .registry import query


def _k(c, scale=1000):
    return F.floor(c * float(scale) + 0.5).cast("long")


@query("join5_geo1_geo2_containing", with_("outlets", "boxes") + f" SELECT o.point_id, (SELECT min(b.key) FROM boxes b WHERE {IN_BOX}) AS key FROM outlets o")
def _(spark, d):
    return spatial.inside(frame(spark, d, "outlets").select("point_id", "lon", "lat"), polygons(spark, d).select("key", "pos", "rings"), how="first").select("point_id", "key")


@query("join6_join23_all_containing", with_("sites", "boxes") + f" SELECT b.key, o.kind, count(*) AS n FROM sites o JOIN boxes b ON {IN_BOX} GROUP BY ALL")
def _(spark, d):
    rows = spatial.inside(frame(spark, d, "sites"), polygons(spark, d).select("key", "pos", "rings"))
    return rows.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("join8_smallest_containing", with_("outlets", "boxes") + f""" SELECT o.point_id, coalesce((SELECT min(b.key) FROM boxes b WHERE {IN_BOX}), 100) AS key FROM outlets o""")
def _(spark, d):
    shape = polygons(spark, d).select("key", "pos", "area_km2", "rings")
    whole = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((100.0, -10.0), (110.0, -10.0), (110.0, 0.0), (100.0, 0.0))])
    # one polygon around all of them: its cells are wide, so it has a grid of its own
    around = spark.range(1).select(F.lit(100).alias("key"), F.lit(-1).alias("pos"), F.lit(1000).alias("area_km2"), F.array(whole).alias("rings"))
    points = frame(spark, d, "outlets").select("point_id", "lon", "lat")
    return spatial.inside(points, shape.unionByName(around), size=0.25, how="smallest").select("point_id", "key")


@query("join9_join10_nearest", with_("outlets", "sites") + f""" SELECT point_id, arg_min(site, (m, site)) AS nearest_id, CAST(floor(min(m) + 0.5) AS BIGINT) AS metres FROM (SELECT o.point_id, p.point_id AS site, {METRES} AS m FROM outlets o, sites p) GROUP BY point_id""")
def _(spark, d):
    rows = spatial.nearest(frame(spark, d, "outlets").select("point_id", "lon", "lat"), frame(spark, d, "sites").select("point_id", "lon", "lat"), 10_000)
    return rows.select("point_id", "nearest_id", _k(F.col("metres"), 1).alias("metres"))


@query("join11_nearest_capped", with_("outlets", "boxes") + f""" SELECT point_id, arg_min(key, (m, key)) AS nearest_id FROM (SELECT o.point_id, p.key, {METRES} AS m FROM outlets o, (SELECT key, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM boxes) p) WHERE m <= 3000 GROUP BY point_id""")
def _(spark, d):
    centres = polygons(spark, d).select(F.col("key").alias("point_id"), F.col("clon").alias("lon"), F.col("clat").alias("lat"))
    rows = spatial.nearest(frame(spark, d, "outlets").select("point_id", "lon", "lat"), centres, 3000, rounds=1)
    return rows.where("nearest_id IS NOT NULL").select("point_id", "nearest_id")


@query("join12_join26_snap_cascade", with_("outlets", "boxes") + f""", o AS (SELECT point_id, lon, lat, CASE WHEN point_id % 3 > 0 THEN 'B' || (nation + CASE WHEN point_id % 4 = 0 THEN 100 ELSE 0 END) END AS name, CASE WHEN point_id % 3 = 1 THEN 'P' || nation END AS parent FROM outlets),
 c AS (SELECT o.point_id, b.key, 1 AS rule, CAST(0 AS DOUBLE) AS d FROM o JOIN boxes b ON {IN_BOX} UNION ALL SELECT point_id, key, 2, 0 FROM o JOIN boxes b ON o.name = 'B' || b.key AND o.parent = 'P' || b.key UNION ALL SELECT point_id, key, 3, 0 FROM o JOIN boxes b ON o.name = 'B' || b.key
 UNION ALL SELECT o.point_id, p.key, 4, {METRES} FROM o, (SELECT key, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM boxes) p WHERE o.name IS NOT NULL AND {METRES} <= 3000)
SELECT coalesce(rule, 0) AS rule, count(*) AS n, CAST(coalesce(sum(key), 0) AS BIGINT) AS keys FROM outlets LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY rule, d, key) AS r FROM c) WHERE r = 1) USING (point_id) GROUP BY 1""")
def _(spark, d):
    # how many points each rule has placed, 0: none; join12_all_rules tells where
    shape = polygons(spark, d).withColumns({"name": F.concat(F.lit("B"), "key"), "parent": F.concat(F.lit("P"), "key")})
    m = F.col("point_id") % 3
    name = F.concat(F.lit("B"), F.col("nation") + F.when(F.col("point_id") % 4 == 0, 100).otherwise(0))
    points = frame(spark, d, "outlets").select("point_id", "lon", "lat", F.when(m > 0, name).alias("name"), F.when(m == 1, F.concat(F.lit("P"), "nation")).alias("parent"))
    rows = points.select("point_id").join(spatial.snapped(points, shape), "point_id", "left")
    return rows.groupBy(F.coalesce("rule", F.lit(0)).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("key"), F.lit(0)).alias("keys"))


@query("join12_all_rules", with_("outlets", "boxes") + f""", o AS (SELECT point_id, lon, lat, CASE point_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'B' || nation WHEN 2 THEN 'B' || nation ELSE 'X' END AS name, CASE WHEN point_id % 8 = 1 THEN 'P' || nation END AS parent FROM outlets),
 c AS (SELECT o.point_id, b.key, 1 AS rule, CAST(0 AS DOUBLE) AS d FROM o JOIN boxes b ON {IN_BOX} UNION ALL SELECT point_id, key, 2, 0 FROM o JOIN boxes b ON o.name = 'B' || b.key AND o.parent = 'P' || b.key UNION ALL SELECT point_id, key, 3, 0 FROM o JOIN boxes b ON o.name = 'B' || b.key
 UNION ALL SELECT o.point_id, p.key, 4, {METRES} FROM o, (SELECT key, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM boxes) p WHERE o.name IS NOT NULL AND {METRES} <= 9000)
SELECT point_id, key, rule FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY rule, d, key) AS r FROM c) WHERE r = 1""")
def _(spark, d):
    # join12_join26_snap_cascade leaves out the nearest centres, as its SQL does; here most names tell nothing
    shape = polygons(spark, d).withColumns({"name": F.concat(F.lit("B"), "key"), "parent": F.concat(F.lit("P"), "key")})
    m = F.col("point_id") % 8
    name = F.when(m.isin(1, 2), F.concat(F.lit("B"), "nation")).when(m > 2, "X")
    points = frame(spark, d, "outlets").select("point_id", "lon", "lat", name.alias("name"), F.when(m == 1, F.concat(F.lit("P"), "nation")).alias("parent"))
    return spatial.snapped(points, shape, 9000.0)


@query("join13_within_radius", with_("sites") + f""" SELECT o.point_id, p.kind, count(*) AS n FROM sites o, sites p WHERE {METRES} <= 15000 GROUP BY ALL""")
def _(spark, d):
    rows = frame(spark, d, "sites").select("point_id", "kind", "lon", "lat")
    return spatial.counts_within(rows, rows, 15000)


@query("join20_adjacency", with_("boxes") + """ SELECT a.key AS a, b.key AS b FROM boxes a JOIN boxes b ON a.key < b.key AND a.x0 - 0.006 <= b.x1 + 0.006 AND b.x0 - 0.006 <= a.x1 + 0.006 AND a.y0 - 0.006 <= b.y1 + 0.006 AND b.y0 - 0.006 <= a.y1 + 0.006""")
def _(spark, d):
    return spatial.adjacent(polygons(spark, d), pad=0.006)


@query("join21_overlap_shares", with_("boxes") + """, s AS (SELECT key, x0, x1, y0, y1, holed, (x0 + (i + CAST(0.5 AS DOUBLE)) * ((x1 - x0) / 50)) AS lon, (y0 + (j + CAST(0.5 AS DOUBLE)) * ((y1 - y0) / 50)) AS lat FROM boxes, range(50) a(i), range(50) c(j)), h AS (SELECT * FROM s WHERE NOT (holed AND lon >= x0 + (x1 - x0) / 3.0 AND lon < x1 - (x1 - x0) / 3.0 AND lat >= y0 + (y1 - y0) / 3.0 AND lat < y1 - (y1 - y0) / 3.0))
SELECT key, region AS cover, count(*) FILTER (WHERE lon >= 106.6 + region * 0.2 AND lon < 106.6 + region * 0.2 + 0.2) AS n_in, count(*) AS n_all FROM h, (SELECT DISTINCT region FROM boxes) r GROUP BY key, cover HAVING n_in >= 0.005 * n_all""")
def _(spark, d):
    covers = frame(spark, d, "boxes").select("region").distinct()
    x = F.lit(106.6) + F.col("region") * 0.2
    corners = F.array(*[F.array(x + a, F.lit(b)) for a, b in ((0.0, -8.0), (0.2, -8.0), (0.2, -5.0), (0.0, -5.0))])
    covers = covers.select(F.col("region").alias("key"), F.array(corners).alias("rings"))
    return spatial.overlap_shares(polygons(spark, d), covers)


def _samples(circles: str, metres: int) -> str:
    """SQL that lists all samples of scanlines in boxes near circles (point_id, lon, lat), and counts them."""
    x = lambda v: f"radians({v} - lon) * CAST(6371008.8 AS DOUBLE) * cos(radians(lat))"
    y = lambda v: f"radians({v} - lat) * CAST(6371008.8 AS DOUBLE)"
    return f""", o AS ({circles}),
 f AS (SELECT point_id, key, population, holed, {x('x0')} AS a, {x('x1')} AS b, {y('y0')} AS c, {y('y1')} AS d FROM o JOIN boxes ON y0 <= lat + {metres} / CAST(110574.0 AS DOUBLE) AND y1 >= lat - {metres} / CAST(110574.0 AS DOUBLE)
  AND x0 <= lon + {metres} / (111320.0 * cos(radians(lat))) AND x1 >= lon - {metres} / (111320.0 * cos(radians(lat)))),
 g AS (SELECT *, a + (b - a) / 3.0 AS ha, b - (b - a) / 3.0 AS hb, c + (d - c) / 3.0 AS hc, d - (d - c) / 3.0 AS hd FROM f),
 l AS (SELECT *, c + (m + CAST(0.5 AS DOUBLE)) * 100.0 AS y FROM (SELECT *, unnest(range(CAST(ceil((d - c) / 100.0 - 0.5) AS BIGINT))) AS m FROM g)),
 s AS (SELECT *, (n + CAST(0.5 AS DOUBLE)) * 100.0 AS x FROM (SELECT *, unnest(range(CAST(floor(a / 100.0) - 1 AS BIGINT), CAST(ceil(b / 100.0) + 1 AS BIGINT))) AS n FROM l)),
 k AS (SELECT point_id, key, any_value(population) AS population, count(*) AS n_in, count(*) FILTER (x * x + y * y <= CAST({metres} AS DOUBLE) * {metres}) AS n_hit
  FROM s WHERE x >= a AND x < b AND NOT (holed AND y > hc AND y <= hd AND x >= ha AND x < hb) GROUP BY point_id, key)"""


_CATCHMENT = """ SELECT {0}, CAST(floor(coalesce(sum(CAST(population AS DOUBLE) * n_hit / n_in), 0) + 0.5) AS BIGINT) AS population, CAST(sum(n_hit) AS BIGINT) AS hectares, count(*) FILTER (n_hit >= 0.999 * n_in) AS n_whole, count(*) FILTER (n_hit < 0.999 * n_in) AS n_partial FROM k WHERE n_hit > 0 GROUP BY point_id"""


def _told_catchment(rows, name):
    return rows.select(name, _k(F.col("population"), 1).alias("population"), _k(F.col("area_km2"), 100).alias("hectares"), "n_whole", "n_partial")


@query("geo16_scanline_counts", with_("sites", "boxes") + _samples("SELECT point_id, lon, lat FROM sites", 3000) + " SELECT point_id, key, n_in, n_hit FROM k")
def _(spark, d):
    return spatial.scan_counts(frame(spark, d, "sites").select("point_id", "lon", "lat"), polygons(spark, d).select("key", "rings"), 3000)


@query("join22_scr7_population_within", with_("sites", "boxes") + _samples("SELECT point_id, lon, lat FROM sites", 2000) + _CATCHMENT.format("point_id"))
def _(spark, d):
    return _told_catchment(spatial.catchments(frame(spark, d, "sites").select("point_id", "lon", "lat"), polygons(spark, d), 2000), "point_id")


# a district is every fourth box; beside a hole its centre lies in the left span
@query("scr7_named_catchments", with_("boxes") + _samples("SELECT name AS point_id, CASE WHEN holed THEN x0 + (x1 - x0) / 6 ELSE (x0 + x1) / 2 END AS lon, (y0 + y1) / 2 AS lat FROM boxes WHERE key % 4 = 0", 10_000) + _CATCHMENT.format("point_id AS name"))
def _(spark, d):
    shape = polygons(spark, d)
    # in a box with a hole the spans on either side are equally wide but for the last bits: take the box without it, moved
    shifted = F.when(F.size("rings") > 1, F.array(F.transform(F.element_at("rings", 1), lambda p: F.array(F.element_at("rings", 1)[0][0] + (p[0] - F.element_at("rings", 1)[0][0]) / 3, p[1])))).otherwise(F.col("rings"))
    return _told_catchment(spatial.named_catchments(shape.where("key % 4 = 0").select("name", shifted.alias("rings")), shape, 10_000), "name")


@query("join25_what_is_here", with_("boxes", "sites") + f""" SELECT b.key, count(*) AS n FROM sites o JOIN boxes b ON {IN_BOX} WHERE b.key IN (SELECT b.key FROM (SELECT CAST(106.62 AS DOUBLE) AS lon, CAST(-6.6 AS DOUBLE) AS lat) o JOIN boxes b ON {IN_BOX}) GROUP BY b.key""")
def _(spark, d):
    shape = polygons(spark, d).select("key", "pos", "rings")
    here = spark.range(1).select(F.lit(106.62).alias("lon"), F.lit(-6.6).alias("lat"))
    hit = spatial.inside(here, shape).select("key")
    return spatial.inside(frame(spark, d, "sites"), shape.join(hit, "key", "left_semi")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("geo3_inner_points", with_("boxes") + """ SELECT key, CASE WHEN holed THEN 70 ELSE 0 END AS off_e3, CAST(floor((y0 + y1) / 2 * 1000 + 0.25) AS BIGINT) AS lat_e3 FROM boxes""")
def _(spark, d):
    # in a box with a hole, the spans on either side of it are equally wide
    rows = polygons(spark, d).select("key", "clon", shapes.inner_point(F.col("rings")).alias("p"))
    return rows.select("key", _k(F.abs(F.col("p.lon") - F.col("clon"))).alias("off_e3"), F.floor(F.col("p.lat") * 1000.0 + 0.25).cast("long").alias("lat_e3"))


@query("geo4_areas", with_("boxes") + """ SELECT key, CAST(floor((x1 - x0) * (y1 - y0) * cos(radians((y0 + y1) / 2)) * 111320.0 * 111320.0 / 1e6 * (CASE WHEN holed THEN CAST(8 AS DOUBLE) / 9 ELSE 1 END) * 100 + 0.5) AS BIGINT) AS hectares FROM boxes""")
def _(spark, d):
    return polygons(spark, d).select("key", _k(geo.polygon_area_km2(F.col("rings"), F.col("clat")), 100).alias("hectares"))


def _metric_points(spark, d):
    rows = frame(spark, d, "outlets")
    return rows.select(F.col("rep").alias("owner"), ((F.col("point_id") * 7919) % 110000).cast("double").alias("x"), ((F.col("point_id") * 104729) % 80000).cast("double").alias("y"))


_STAMPS = """WITH p AS (SELECT CAST(c_custkey % 97 AS BIGINT) AS owner, CAST((c_custkey * 7919) % 110000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 80000 AS DOUBLE) AS y FROM customer),
 s AS (SELECT owner, CAST(floor(x / 500) AS INTEGER) + a AS i, CAST(floor(y / 500) AS INTEGER) + b AS j, x, y FROM p, range(-2, 3) r(a), range(-2, 3) t(b)),
 c AS (SELECT owner, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, pow((i + CAST(0.5 AS DOUBLE)) * 500 - x, 2) + pow((j + CAST(0.5 AS DOUBLE)) * 500 - y, 2) AS d2 FROM s WHERE pow((i + CAST(0.5 AS DOUBLE)) * 500 - x, 2) + pow((j + CAST(0.5 AS DOUBLE)) * 500 - y, 2) <= 1000000)"""


@query("geo6_set6_coverage", _STAMPS + """, u AS (SELECT DISTINCT owner, i, j FROM c) SELECT count(*) AS cells, count(DISTINCT (i, j)) AS distinct_cells, CAST(floor((1 - CAST(count(DISTINCT (i, j)) AS DOUBLE) / count(*)) * 1000000 + 0.5) AS BIGINT) AS overlap_e6 FROM u""")
def _(spark, d):
    return lattice.overlap(lattice.covered(_metric_points(spark, d), 500.0, 1000.0)).select("cells", "distinct_cells", _k(F.col("overlap"), 1_000_000).alias("overlap_e6"))


@query("geo7_exclusive_cells", _STAMPS + """ SELECT i, j, arg_min(owner, (d2, owner)) AS owner FROM c GROUP BY i, j""")
def _(spark, d):
    return lattice.owned(_metric_points(spark, d), 500.0, 1000.0)


@query("geo8_islands")
def _(spark, d):
    return lattice.absorbed(lattice.owned(_metric_points(spark, d), 500.0, 1000.0))


_OWNED = _STAMPS + """, o AS (SELECT i, j, arg_min(owner, (d2, owner)) AS owner FROM c GROUP BY i, j)"""


def _walked(seams: bool) -> str:
    """SQL for outlines of exclusive cells, edge by edge, with two rounds of cut corners."""
    prev, after = "l[CASE WHEN k = 1 THEN len(l) ELSE k - 1 END]", "l[CASE WHEN k = len(l) THEN 1 ELSE k + 1 END]"
    between = lambda n: "{'x': v.x * %s + %s.x * %s, 'y': v.y * %s + %s.y * %s, 'free': v.free, 'node': false}" % (1 - n, after, n, 1 - n, after, n)
    if seams:
        cut = f"CASE WHEN v.node THEN [v, {between(0.25)}, {between(0.75)}] ELSE [{between(0.25)}, {between(0.75)}] END"
    else:
        cut = f"CASE WHEN {prev}.free AND v.free THEN [{between(0.25)}, {between(0.75)}] WHEN v.free THEN [v, {between(0.75)}] ELSE [v] END"
    node = "(SELECT count(*) FROM border WHERE border.x = w.x1 AND border.y = w.y1) > 2" if seams else "false"
    cross = "list_sum(list_transform(l, lambda v, k: v.x * {0}.y - {0}.x * v.y))".format(after)
    return _OWNED.replace("WITH p", "WITH RECURSIVE p", 1) + f""", e AS (
  SELECT a.owner, a.i + x1 AS x1, a.j + y1 AS y1, a.i + x2 AS x2, a.j + y2 AS y2, b.owner IS NULL AS free FROM o AS a, (VALUES (0, 0, 1, 0, 0, -1), (1, 0, 1, 1, 1, 0), (1, 1, 0, 1, 0, 1), (0, 1, 0, 0, -1, 0)) AS v(x1, y1, x2, y2, di, dj)
  LEFT JOIN o AS b ON b.i = a.i + di AND b.j = a.j + dj WHERE b.owner IS DISTINCT FROM a.owner),
 side AS (SELECT DISTINCT least((x1, y1), (x2, y2)) AS p, greatest((x1, y1), (x2, y2)) AS q FROM e),
 border AS (SELECT p[1] AS x, p[2] AS y FROM side UNION ALL SELECT q[1], q[2] FROM side),
 n AS (SELECT e.*, arg_max((f.x2, f.y2), (e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1)) AS t FROM e JOIN e AS f ON f.owner = e.owner AND f.x1 = e.x2 AND f.y1 = e.y2 GROUP BY ALL),
 w AS (
  SELECT owner, (x1, y1, x2, y2) AS start, 0 AS k, x1, y1, x2, y2, free, t FROM n
  UNION ALL
  SELECT n.owner, start, k + 1, n.x1, n.y1, n.x2, n.y2, n.free, n.t FROM w JOIN n ON n.owner = w.owner AND n.x1 = w.x2 AND n.y1 = w.y2 AND n.x2 = w.t[1] AND n.y2 = w.t[2] WHERE (n.x1, n.y1, n.x2, n.y2) > start),
 whole AS (SELECT owner, start FROM w WHERE (x2, y2) = (start[1], start[2]) AND (x2, y2, t[1], t[2]) = start),
 r AS (SELECT owner, start, list({{'x': CAST(x1 AS DOUBLE), 'y': CAST(y1 AS DOUBLE), 'free': free, 'node': {node}}} ORDER BY k) AS l FROM w JOIN whole USING (owner, start) GROUP BY ALL),
 m AS (SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY start) - 1 AS INTEGER) AS ring, {cross} < 0 AS is_hole, l FROM r),
 m0 AS (SELECT owner, ring, is_hole, list_filter(l, lambda v, k: NOT ((v.x - {prev}.x) * ({after}.y - v.y) = (v.y - {prev}.y) * ({after}.x - v.x) AND v.free = {prev}.free AND NOT v.node)) AS l FROM m),
 m1 AS (SELECT owner, ring, is_hole, flatten(list_transform(l, lambda v, k: {cut})) AS l FROM m0),
 m2 AS (SELECT owner, ring, is_hole, flatten(list_transform(l, lambda v, k: {cut})) AS l FROM m1)
SELECT owner, ring, is_hole, array_to_string(list_transform(l, lambda v: CAST(v.x * 2000 AS BIGINT) || ' ' || CAST(v.y * 2000 AS BIGINT)), ',') AS points FROM m2"""


def _quarters(points):
    """Points in quarters of a metre, in which two rounds on cells of 500 m are whole, as text."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", _k(p[0], 4), _k(p[1], 4))), ",")


@query("geo9_geo11_outlines", _walked(False))
def _(spark, d):
    return outline.outlines(lattice.owned(_metric_points(spark, d), 500.0, 1000.0), 500.0, 2).select("owner", "ring", "is_hole", _quarters(F.col("points")).alias("points"))


@query("geo9_smoothed_seams", _walked(True))
def _(spark, d):
    return outline.outlines(lattice.owned(_metric_points(spark, d), 500.0, 1000.0), 500.0, 2, seams=True).select("owner", "ring", "is_hole", _quarters(F.col("points")).alias("points"))


@query("geo11_territories", _STAMPS + """, u AS (SELECT owner, count(DISTINCT (i, j)) * 250000 AS area_m2 FROM c GROUP BY owner), q AS (SELECT owner, count(*) AS n_points FROM p GROUP BY owner)
SELECT owner, n_points, n_points < 16 AS skipped, CASE WHEN n_points >= 16 THEN CAST(area_m2 AS BIGINT) END AS area_m2 FROM q JOIN u USING (owner)""")
def _(spark, d):
    shapes, skipped, _ = outline.territories(_metric_points(spark, d), "coverage", rounds=0, least=16)
    rows = shapes.select("owner", "n_points", F.lit(False).alias("skipped"), _k(F.col("area_m2"), 1).alias("area_m2"))
    return rows.union(skipped.select("owner", "n_points", F.lit(True), F.lit(None).cast("long")))


@query("geo10_hulls")
def _(spark, d):
    return lattice.hulls(_metric_points(spark, d))


#: Squares that touch, numbered along rows of five; a group is a row, or a row but for its middle square.
_SQUARES = """WITH q AS (SELECT n_nationkey AS key, n_nationkey // 5 AS grp, CAST(n_nationkey % 5 AS BIGINT) * 10000000 AS x, CAST(n_nationkey // 5 AS BIGINT) * 10000000 AS y FROM nation)"""


def _squares(spark, d):
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("key"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("grp"), F.array(ring).alias("rings"))


@query("geo12_dissolve", _SQUARES + """, e AS (SELECT grp, x AS x1, y AS y1, x + 10000000 AS x2, y AS y2 FROM q UNION ALL SELECT grp, x, y + 10000000, x + 10000000, y + 10000000 FROM q UNION ALL SELECT grp, x, y, x, y + 10000000 FROM q UNION ALL SELECT grp, x + 10000000, y, x + 10000000, y + 10000000 FROM q)
SELECT CAST(grp AS INTEGER) AS grp, x1, y1, x2, y2 FROM e GROUP BY ALL HAVING count(*) = 1""")
def _(spark, d):
    return lattice.outer_edges(_squares(spark, d), "grp")


# parts less holes by the patterns of two by two cells: one cell, three, or two that touch at a corner
@query("geo12_stitched", _OWNED + """, v AS (SELECT owner, i + a AS i, j + b AS j, a + 2 * b AS place FROM o, range(2) r(a), range(2) t(b)),
 q AS (SELECT owner, i, j, count(*) AS n, sum(place) AS places FROM v GROUP BY ALL),
 x AS (SELECT owner, CAST((count(*) FILTER (n = 1) - count(*) FILTER (n = 3) + 2 * count(*) FILTER (n = 2 AND places = 3)) // 4 AS BIGINT) AS parts_less_holes FROM q GROUP BY owner),
 y AS (SELECT o.owner, count(*) AS area, CAST(sum(4 - (SELECT count(*) FROM o AS b WHERE b.owner = o.owner AND abs(b.i - o.i) + abs(b.j - o.j) = 1)) AS BIGINT) AS points FROM o GROUP BY o.owner)
SELECT owner, parts_less_holes, points, area FROM x JOIN y USING (owner)""")
def _(spark, d):
    # squares of a thousandth, of which owners have many that touch, enclose others' or lie apart
    corner = lambda a, b: F.array((F.col("i") + a) / 1000.0, (F.col("j") + b) / 1000.0)
    ring = F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    squares = lattice.owned(_metric_points(spark, d), 500.0, 1000.0).select("owner", F.array(F.when((F.col("i") + F.col("j")) % 2 == 0, ring).otherwise(F.reverse(ring))).alias("rings"))
    flat = lambda r: outline.twice_area(F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))) / 2
    rows = outline.dissolved(squares, "owner").select("owner", F.size("rings").alias("n"), F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r)).alias("points"), F.aggregate("rings", F.lit(0.0), lambda s, r: s + flat(r)).alias("area"))
    return rows.groupBy("owner").agg(F.sum(2 - F.col("n")).cast("long").alias("parts_less_holes"), F.sum("points").cast("long").alias("points"), _k(F.sum("area"), 1_000_000).alias("area"))


@query("geo14_geo15_simplified", with_("boxes") + """, c AS (SELECT key, unnest([{'k': 0, 'x': x0, 'y': y0}, {'k': 1, 'x': x1, 'y': y0}, {'k': 2, 'x': x1, 'y': y1}, {'k': 3, 'x': x0, 'y': y1}]) AS p FROM boxes)
SELECT key, string_agg(CAST(floor(p.x * 100000 + 0.5) AS BIGINT) || ' ' || CAST(floor(p.y * 100000 + 0.5) AS BIGINT), ',' ORDER BY p.k) AS ring FROM c GROUP BY key""")
def _(spark, d):
    # a point added in the middle of the first side goes again, and so does one beside the second corner
    outer = F.element_at("rings", 1)
    middle = F.array((outer[0][0] + outer[1][0]) / 2, outer[0][1])
    beside = F.array(outer[1][0], outer[1][1] + 0.00002)
    rows = polygons(spark, d).select("key", F.concat(F.slice(outer, 1, 1), F.array(middle), F.slice(outer, 2, 1), F.array(beside), F.slice(outer, 3, 2)).alias("ring"))
    ring = shapes.thinned_ring(shapes.simplified(F.col("ring"), 1e-4), 1e-4)
    return rows.select("key", F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", _k(p[0], 100000).cast("string"), _k(p[1], 100000).cast("string"))), ",").alias("ring"))


@query("join28_merged_parts", with_("boxes") + """ SELECT region, string_agg(CAST(floor(x0 * 100000 + 0.5) AS BIGINT) || ' ' || CAST(floor(y0 * 100000 + 0.5) AS BIGINT) || CASE WHEN holed THEN ' holed' ELSE '' END, ',' ORDER BY x0, y0) AS polys, count(*) AS parts FROM boxes GROUP BY region""")
def _(spark, d):
    rows = shapes.merged_parts(polygons(spark, d).select("region", F.array("rings").alias("polys")), "region")
    one = lambda rings: F.concat_ws(" ", _k(rings[0][0][0], 100000).cast("string"), _k(rings[0][0][1], 100000).cast("string"), F.when(F.size(rings) > 1, "holed"))
    return rows.select("region", F.array_join(F.transform("polys", one), ",").alias("polys"), "parts")


@query("win1_win2_percentiles", with_("outlets") + """, t AS (SELECT point_id, nation, CASE WHEN point_id % 10 = 0 THEN NULL ELSE value % 50 END AS v FROM outlets),
 r AS (SELECT *, rank() OVER (PARTITION BY nation, v IS NOT NULL ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY nation, v IS NOT NULL, v) AS k, count(*) OVER (PARTITION BY nation, v IS NOT NULL) AS n FROM t)
SELECT point_id, CAST(floor((CASE WHEN v IS NULL OR n = 1 THEN CAST(0.5 AS DOUBLE) ELSE (CAST(r AS DOUBLE) + CAST(k - 1 AS DOUBLE) / 2) / (n - 1) END) * 10000 + 0.5) AS BIGINT) AS pct FROM r""")
def _(spark, d):
    rows = frame(spark, d, "outlets").select("point_id", "nation", F.when(F.col("point_id") % 10 != 0, F.expr("CAST(value AS BIGINT) % 50")).alias("v"))
    return rows.select("point_id", _k(siting.percentile(F.col("v"), "nation"), 10000).alias("pct"))


@query("win3_percentile_against", with_("outlets", "sites") + """, a AS (SELECT point_id, CAST(nation AS BIGINT) AS g, CAST(weight AS BIGINT) AS v FROM outlets), b AS (SELECT CAST(point_id % 25 AS BIGINT) AS g, CAST(point_id % 7 + 1 AS BIGINT) AS v FROM sites)
SELECT point_id, CAST(floor(coalesce((count(*) FILTER (WHERE b.v < a.v) + count(*) FILTER (WHERE b.v <= a.v)) / CAST(2 AS DOUBLE) / nullif(count(b.v), 0), 0.5) * 10000 + 0.5) AS BIGINT) AS pct FROM a LEFT JOIN b USING (g) GROUP BY point_id""")
def _(spark, d):
    rows = frame(spark, d, "outlets").select("point_id", F.col("nation").cast("long").alias("g"), F.col("weight").alias("v"))
    sample = frame(spark, d, "sites").select((F.col("point_id") % 25).alias("g"), (F.col("point_id") % 7 + 1).alias("v"))
    return siting.percentile_against(rows, sample, "v", "g", "pct").select("point_id", _k(F.col("pct"), 10000).alias("pct"))


def _areas(spark, d):
    """Areas with every input of the model, from whole numbers."""
    k = F.col("c_custkey")
    n = lambda a, m: ((k * a) % m).cast("double")
    rows = spark.read.parquet(f"{d}/customer.parquet")
    rows = rows.select(k.alias("area_key"), F.when(k % 3 == 0, "urban").otherwise("rural").alias("profile"), n(7919, 50000).alias("population"), n(7919, 977).alias("pop_density"), (n(104729, 200000)).alias("vlr"), F.when(k % 7 != 0, n(31, 100) / 100).alias("ms_ioh"), n(17, 61).alias("atm_den"), n(19, 53).alias("bank_den"), n(23, 71).alias("minimarket_den"), n(29, 83).alias("vlr_per_site"), n(37, 13).alias("site_count"), n(41, 20).alias("km_hybrid"), n(43, 10).alias("pasar_n"), (n(43, 10) / (k % 9 + 1)).alias("pasar_den"), n(47, 3).alias("own_stores"), n(53, 4).alias("comp_stores"), (n(53, 4) / (k % 9 + 1)).alias("comp_den"), n(61, 23).alias("km_im3"), n(67, 29).alias("km_3id"), F.least(n(61, 23), n(67, 29)).alias("km_own"), (k % 9 + 1).alias("area_km2"))
    return siting.densities(rows, [])


def _model_sql() -> str:
    """The scoring model with its usual settings over ``_areas``, as a chain of common table expressions that ends in ``z``."""
    num = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    n = lambda a, m: f"CAST((c_custkey * {a}) % {m} AS DOUBLE)"
    areas = f"""a AS (SELECT c_custkey AS area_key, CASE WHEN c_custkey % 3 = 0 THEN 'urban' ELSE 'rural' END AS profile, {n(7919, 50000)} AS population, {n(7919, 977)} AS pop_density, {n(104729, 200000)} AS vlr,
 CASE WHEN c_custkey % 7 <> 0 THEN {n(31, 100)} / 100 END AS ms_ioh, {n(17, 61)} AS atm_den, {n(19, 53)} AS bank_den, {n(23, 71)} AS minimarket_den, {n(29, 83)} AS vlr_per_site, {n(37, 13)} AS site_count, {n(41, 20)} AS km_hybrid, {n(43, 10)} / (c_custkey % 9 + 1) AS pasar_den FROM customer)"""
    inputs = ("pop_density", "vlr", "ms_ioh", "atm_den", "bank_den", "minimarket_den", "pasar_den", "vlr_per_site", "site_count")
    place = lambda c, by: f"""CASE WHEN {c} IS NULL OR count({c}) OVER (PARTITION BY {by}) = 1 THEN CAST('0.5' AS DOUBLE) ELSE (CAST(rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) - 1 AS DOUBLE) + CAST(count(*) OVER (PARTITION BY {by}, {c}) - 1 AS DOUBLE) / 2) / (count({c}) OVER (PARTITION BY {by}) - 1) END"""
    placed = f"p AS (SELECT *, {', '.join(f'{place(c, by)} AS {c}_{tag}' for c in inputs for tag, by in (('t', '1'), ('s', 'profile')))} FROM a)"
    w = siting.renormalised(siting.TERM_WEIGHTS, {"cpi": False}, 0.15)
    v = siting.renormalised(siting.VITALITY_WEIGHTS, {})

    def score(tag):
        finance = f"(atm_den_{tag} * {num(0.6)} + bank_den_{tag} * {num(0.4)})"
        cvi = f"({finance} * {num(v['finance'])} + minimarket_den_{tag} * {num(v['minimarket'])} + pasar_den_{tag} * {num(v['pasar'])})"
        network = f"(vlr_per_site_{tag} * {num(0.6)} + site_count_{tag} * {num(0.4)})"
        far = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (km_hybrid - 2) / 13))"
        parts = ((f"pop_density_{tag}", "population"), (f"vlr_{tag}", "vlr_total"), (f"ms_ioh_{tag}", "ms_score"), (cvi, "cvi"), (network, "network"), (far, "distance"))
        return f"floor(({' + '.join(f'{x} * {num(w[k])}' for x, k in parts)}) * 100 * CAST(100 AS DOUBLE) + CAST('0.5' AS DOUBLE)) / CAST(100 AS DOUBLE)"

    half = "CAST('0.5' AS DOUBLE)"
    return f"""WITH {areas}, {placed}, q AS (SELECT *, {score('s')} AS own, {score('t')} AS other, floor(vlr_t * 100 * CAST(10 AS DOUBLE) + {half}) / CAST(10 AS DOUBLE) AS vlr_pct, CASE WHEN ms_ioh IS NOT NULL THEN floor(ms_ioh_t * 100 * CAST(10 AS DOUBLE) + {half}) / CAST(10 AS DOUBLE) END AS ms_pct FROM p),
 g AS (SELECT *, vlr < 80000 AS f1, vlr_pct < 40 AS f2, coalesce(ms_pct < 40, false) AS f3 FROM q),
 z AS (SELECT *, NOT (f1 OR f2 OR f3) AS eligible, CASE WHEN NOT (f1 OR f2 OR f3) THEN own END AS score FROM g)"""


@query("win4_win5_scr1_scr4_ranking", _model_sql() + """ SELECT area_key, CAST(floor(score * 100 + 0.5) AS BIGINT) AS score_x100, rank, rank_in_profile FROM (SELECT *, row_number() OVER (ORDER BY score DESC, area_key) AS rank, row_number() OVER (PARTITION BY profile ORDER BY score DESC, area_key) AS rank_in_profile FROM z WHERE eligible)""")
def _(spark, d):
    rows = siting.scored(_areas(spark, d), siting.Params().merged({"strategy": "densify", "unknown": 1}))
    return rows.where("eligible").select("area_key", _k(F.col("score"), 100).alias("score_x100"), F.col("rank").cast("long").alias("rank"), F.col("rank_in_profile").cast("long").alias("rank_in_profile"))


@query("scr2_scr3_scores", _model_sql() + """ SELECT area_key, profile, CAST(floor(score * 100 + 0.5) AS BIGINT) AS score_x100, CAST(floor(other * 100 + 0.5) AS BIGINT) AS other_x100, eligible, CASE WHEN eligible THEN row_number() OVER (ORDER BY score DESC NULLS LAST, area_key) END AS rank,
 CASE WHEN eligible THEN row_number() OVER (PARTITION BY profile ORDER BY score DESC NULLS LAST, area_key) END AS rank_in_profile, concat_ws(',', CASE WHEN f1 THEN 'vlr' END, CASE WHEN f2 THEN 'vlr_pct' END, CASE WHEN f3 THEN 'share' END) AS fails FROM z""")
def _(spark, d):
    rows = siting.scored(_areas(spark, d))
    return rows.select("area_key", "profile", _k(F.col("score"), 100).alias("score_x100"), _k(F.col("score_other"), 100).alias("other_x100"), "eligible", F.col("rank").cast("long").alias("rank"), F.col("rank_in_profile").cast("long").alias("rank_in_profile"), F.array_join("gate_fails", ",").alias("fails"))


@query("agg25_gate_counts", _model_sql() + """ SELECT 'distance' AS gate, count(*) AS passes FROM z UNION ALL SELECT 'vlr', count(*) FILTER (WHERE NOT f1) FROM z UNION ALL SELECT 'vlr_pct', count(*) FILTER (WHERE NOT f2) FROM z UNION ALL SELECT 'share', count(*) FILTER (WHERE NOT f3) FROM z""")
def _(spark, d):
    return siting.gate_counts(siting.scored(_areas(spark, d)))


@query("agg25_all_gates", _model_sql() + """ SELECT 'distance' AS gate, count(*) AS passes FROM z UNION ALL SELECT 'vlr', count(*) FILTER (WHERE vlr >= 80000) FROM z UNION ALL SELECT 'vlr_pct', count(*) FILTER (WHERE vlr_pct >= 40) FROM z UNION ALL SELECT 'share', count(*) FILTER (WHERE ms_pct IS NULL OR ms_pct >= 40) FROM z""")
def _(spark, d):
    return siting.gate_counts(siting.scored(_areas(spark, d), siting.Params(scope="territory")))


@query("agg26_summary", _model_sql() + """ SELECT count(*) AS n, count(score) AS n_eligible, CAST(floor(CAST(sum(CAST(floor(score * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(score) + 0.5) AS BIGINT) AS mean_x100,
 CAST(floor(CAST(sum(CAST(floor(score * 100 + 0.5) AS BIGINT)) FILTER (WHERE profile = 'urban') AS DOUBLE) / count(score) FILTER (WHERE profile = 'urban') + 0.5) AS BIGINT) AS urban_x100, CAST(floor(CAST(sum(CAST(floor(score * 100 + 0.5) AS BIGINT)) FILTER (WHERE profile = 'rural') AS DOUBLE) / count(score) FILTER (WHERE profile = 'rural') + 0.5) AS BIGINT) AS rural_x100 FROM z""")
def _(spark, d):
    return siting.summary(siting.scored(_areas(spark, d)))


@query("agg27_availability", with_("outlets") + """ SELECT avg(CASE WHEN weight > 3 THEN 1.0 ELSE 0.0 END) >= 0.6 AS pasar, count(*) FILTER (WHERE value < 0) > 0 AS atm, count(*) FILTER (WHERE village > 10) > 0 AS bank FROM outlets""")
def _(spark, d):
    found = siting.availability(frame(spark, d, "outlets"), {"pasar": 0.6}, {"pasar": F.col("weight") > 3, "atm": F.col("value") < 0, "bank": F.col("village") > 10})
    return spark.createDataFrame([(found["pasar"], found["atm"], found["bank"])], "pasar boolean, atm boolean, bank boolean")


@query("scr5_candidates", with_("sites", "boxes") + f""", p AS (SELECT o.point_id, (SELECT min(b.key) FROM boxes b WHERE {IN_BOX}) AS key FROM sites o), s AS (SELECT *, CASE WHEN key IS NOT NULL THEN CASE WHEN key % 4 = 3 THEN 0 ELSE CAST(key AS DOUBLE) END * CAST('0.5' AS DOUBLE) + CAST(point_id % 11 AS DOUBLE) / 10 * 100 * CAST('0.5' AS DOUBLE) END AS score FROM p)
SELECT point_id, CAST(floor(score * 100 + 0.5) AS BIGINT) AS score_x100, CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY score DESC NULLS LAST, point_id) END AS rank, CASE WHEN score IS NULL THEN 'outside' ELSE 'ok' END AS state FROM s""")
def _(spark, d):
    rows = spatial.inside(frame(spark, d, "sites").select("point_id", "lon", "lat"), polygons(spark, d).select("key", "pos", "rings"), how="first")
    district = F.when(F.col("key") % 4 != 3, F.col("key").cast("double"))
    scored = rows.withColumn("score", F.when(F.col("key").isNotNull(), siting.candidate_score(district, (F.col("point_id") % 11).cast("double") / 10)))
    ranked = siting.ranked(scored.withColumn("all", F.lit(1)), "score", "point_id", "all")
    return ranked.select("point_id", _k(F.col("score"), 100).alias("score_x100"), F.col("rank").cast("long").alias("rank"), F.when(F.col("rank").isNull(), "outside").otherwise("ok").alias("state"))


@query("agg10_agg11_placement", with_("outlets", "boxes") + f""", p AS (SELECT o.*, (SELECT min(b.key) FROM boxes b WHERE {IN_BOX}) AS key FROM outlets o) SELECT coalesce(key, -1) AS key, count(*) AS outlets, count(DISTINCT rep) AS reps, CAST(sum(value) AS BIGINT) AS value FROM p GROUP BY 1""")
def _(spark, d):
    placed = spatial.inside(frame(spark, d, "outlets"), polygons(spark, d).select("key", "pos", "rings"), how="first")
    return placed.groupBy(F.coalesce("key", F.lit(-1)).alias("key")).agg(F.count(F.lit(1)).alias("outlets"), F.count_distinct("rep").alias("reps"), F.sum("value").alias("value"))


@query("agg12_coverage_summary", with_("outlets", "boxes") + f""", p AS (SELECT o.*, (SELECT min(b.key) FROM boxes b WHERE {IN_BOX}) AS key FROM outlets o) SELECT count(*) AS outlets, count(key) AS placed, count(DISTINCT key) AS areas, count(DISTINCT rep) AS reps FROM p""")
def _(spark, d):
    placed = spatial.inside(frame(spark, d, "outlets"), polygons(spark, d).select("key", "pos", "rings"), how="first")
    return placed.agg(F.count(F.lit(1)).alias("outlets"), F.count("key").alias("placed"), F.count_distinct("key").alias("areas"), F.count_distinct("rep").alias("reps"))


@query("geo13_join30_force_fit")
def _(spark, d):
    shape = polygons(spark, d)
    placed = spatial.inside(frame(spark, d, "outlets"), shape.select("key", "pos", "rings"), how="first").where("key IS NOT NULL").withColumn("rep", F.col("rep") % 9)
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("outlets"))
    owner = territory.majority(placed.withColumn("one", F.lit(1)), "key", "rep", F.col("one")).select("key", F.col("rep").alias("owner"))
    villages = sizes.join(owner, "key").select(F.col("key").alias("village"), "owner", "outlets", F.when(F.col("key") % 2 == 0, "urban").otherwise("rural").alias("stratum"))
    return forcefit.rebalanced(villages, spatial.adjacent(shape, pad=0.006))


@query("scr8_violation", with_("outlets") + """, v AS (SELECT nation % 6 AS owner, nation AS village, count(*) AS outlets, nation % 2 = 1 AS rural FROM outlets GROUP BY nation), s AS (SELECT owner, count(*) AS nv, CAST(sum(outlets) AS BIGINT) AS no, count(*) FILTER (WHERE rural) * 2 > count(*) AS rural FROM v GROUP BY owner)
SELECT owner, nv AS n_villages, no AS n_outlets, CAST(floor((CASE WHEN rural THEN CASE WHEN nv > 5 THEN (nv - 5) * (CASE WHEN nv > 7 THEN 3 ELSE 1 END) WHEN nv < 1 THEN 1 - nv ELSE 0 END ELSE CASE WHEN nv > 3 THEN (nv - 3) * (CASE WHEN nv > 4 THEN 3 ELSE 1 END) WHEN nv < 1 THEN 1 - nv ELSE 0 END END
 + greatest(0, no - (CASE WHEN rural THEN 60 ELSE 70 END), 50 - no) / CAST(20 AS DOUBLE)) * 1000 + 0.5) AS BIGINT) AS violation FROM s""")
def _(spark, d):
    rows = frame(spark, d, "outlets").groupBy(F.col("nation").alias("village")).agg(F.count(F.lit(1)).alias("outlets"))
    rows = rows.withColumns({"owner": F.col("village") % 6, "stratum": F.when(F.col("village") % 2 == 1, "rural").otherwise("urban")})
    return forcefit.state(rows).select("owner", "n_villages", "n_outlets", _k(F.col("violation")).alias("violation"))


_STRAYS = f""", o AS (SELECT point_id, rep, lon, lat, nation, CASE WHEN nation % 2 = 0 THEN 'urban' ELSE 'rural' END AS stratum FROM outlets), m AS (SELECT o.point_id, min({METRES}) / 1000 AS km FROM o JOIN o p ON o.rep = p.rep AND p.point_id <> o.point_id GROUP BY o.point_id),
 s AS (SELECT o.*, km, km > 50 AS wrong FROM o JOIN m USING (point_id) WHERE km > CASE WHEN stratum = 'urban' THEN CAST('1.5' AS DOUBLE) ELSE CAST(4 AS DOUBLE) END)"""


def _strayed(spark, d):
    outlets = frame(spark, d, "outlets").withColumn("stratum", F.when(F.col("nation") % 2 == 0, "urban").otherwise("rural"))
    return outlets, review.strays(outlets, review.limit_km(F.col("stratum")))


@query("join19_strays", with_("outlets") + _STRAYS + """ SELECT point_id, CAST(floor(km * 1000 + 0.5) AS BIGINT) AS metres, wrong FROM s""")
def _(spark, d):
    return _strayed(spark, d)[1].select("point_id", _k(F.col("km_own"), 1000).alias("metres"), "wrong")


@query("join19_agg23_receivers")
def _(spark, d):
    outlets, stray = _strayed(spark, d)
    ground = review.seams(outlets, _borders(spark, d)).select("point_id", F.col("owner").alias("to"))
    return review.receivers(review.offers(stray.where("NOT wrong"), outlets, 5.0), ground)


@query("agg23_stray_totals")
def _(spark, d):
    outlets, stray = _strayed(spark, d)
    moved = review.receivers(review.offers(stray.where("NOT wrong"), outlets, 5.0))
    return review.totals(outlets, stray, moved, "stratum", "nation")


def _borders(spark, d):
    """Each box is the ground of the rep with its number."""
    return polygons(spark, d).select(F.col("key").cast("long").alias("owner"), "pos", "rings")


@query("geo18_seam_outlets", with_("outlets", "boxes") + f""" SELECT o.point_id, CAST(b.key AS BIGINT) AS owner FROM outlets o JOIN boxes b ON {IN_BOX} WHERE b.key <> o.rep""")
def _(spark, d):
    return review.seams(frame(spark, d, "outlets"), _borders(spark, d))


@query("src4_live_radius", with_("sites") + f""" SELECT o.point_id, CAST(floor({METRES} + 0.5) AS BIGINT) AS metres FROM sites o, (SELECT CAST(-6.2 AS DOUBLE) AS lat, CAST(107.1 AS DOUBLE) AS lon) p WHERE {METRES} <= 30000 ORDER BY {METRES}, o.point_id LIMIT 40""")
def _(spark, d):
    from terrafold.sources.files import around

    return around(frame(spark, d, "sites"), -6.2, 107.1, 30000, 40).select("point_id", _k(F.col("metres"), 1).alias("metres"))


@query("src13_src14_tiles", with_("boxes") + """, s AS (SELECT key, x0, y0, y1 - y0 AS high, x1 - x0 AS wide, CAST(2000 AS DOUBLE) / CAST(111320 AS DOUBLE) AS step, CAST(2000 AS DOUBLE) / CAST(111320 AS DOUBLE) / cos(radians((y0 + y1) / 2)) AS across FROM boxes), n AS (SELECT *, CAST(greatest(1, ceil(wide / across)) AS BIGINT) AS nx, CAST(greatest(1, ceil(high / step)) AS BIGINT) AS ny FROM s)
SELECT key, nx * ny AS tiles, CAST(floor((x0 + (nx - 1 + CAST('0.5' AS DOUBLE)) * across) * 10000 + 0.5) AS BIGINT) AS last_lon, CAST(floor((y0 + (ny - 1 + CAST('0.5' AS DOUBLE)) * step) * 10000 + 0.5) AS BIGINT) AS last_lat FROM n""")
def _(spark, d):
    from terrafold.sources.files import tiles

    boxes = frame(spark, d, "boxes").select(F.col("key").alias("box"), F.col("y0").alias("south"), F.col("x0").alias("west"), F.col("y1").alias("north"), F.col("x1").alias("east"))
    return tiles(boxes, 2.0).groupBy(F.col("box").alias("key")).agg(F.count(F.lit(1)).alias("tiles"), _k(F.max("lon"), 10000).alias("last_lon"), _k(F.max("lat"), 10000).alias("last_lat"))
