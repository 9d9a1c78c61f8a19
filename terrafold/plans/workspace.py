"""Queries over base rows, point unions, service points, stamps and status counts (AGG-7, 24, 34, 35, FLT-8, 11, 12, 16, JOIN-29, 32, 33, SRC-33, SNK-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import spatial, workspace

from .fixtures import IN_BOX, METRES, frame, polygons, with_
from .registry import query


def _pick(column, *names):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(column) % len(names) + 1).cast("int"))


def _case(column, *names):
    return f"CASE {column} % {len(names)} " + " ".join(f"WHEN {k} THEN {'NULL' if x is None else repr(x)}" for k, x in enumerate(names)) + " END"


_GEO = ("", "urban", "rural", None)


@query("agg7_base_rows", with_("outlets", "boxes") + f""", v AS (SELECT s_nationkey AS key, CAST(s_suppkey % 1000 AS BIGINT) AS population, {_case('s_suppkey', *_GEO)} AS geo FROM supplier),
 g AS (SELECT key, geo, count(*) AS n FROM v WHERE geo <> '' GROUP BY ALL), l AS (SELECT key, count(*) AS n, CAST(sum(population) AS BIGINT) AS population FROM v GROUP BY key),
 p AS (SELECT b.key, count(*) AS outlets, count(DISTINCT rep) AS reps, CAST(sum(value) AS BIGINT) AS value FROM outlets o JOIN boxes b ON {IN_BOX} GROUP BY b.key), n AS (SELECT DISTINCT nation AS key FROM outlets WHERE nation % 2 = 0)
SELECT b.key, coalesce(l.n, 0) AS n_villages, coalesce(l.population, 0) AS population, coalesce(l.n, 0) AS area_km2, coalesce((SELECT string_agg(geo || '=' || g.n, ',' ORDER BY geo) FROM g WHERE g.key = b.key), '') AS geo,
 coalesce(p.outlets, 0) AS outlets, coalesce(p.reps, 0) AS reps, coalesce(p.value, 0) AS value, p.key IS NOT NULL OR n.key IS NOT NULL AS has_data FROM boxes b LEFT JOIN l USING (key) LEFT JOIN p USING (key) LEFT JOIN n USING (key)""")
def _(spark, d):
    boxes = frame(spark, d, "boxes").select("key", F.concat(F.lit(" "), F.lower("name")).alias("name"), F.concat(F.lit("R"), "region").alias("parent"))
    dim = boxes.select(F.col("key").alias("nation"), F.upper("name").alias("name"), F.lower("parent").alias("parent"))
    villages = spark.read.parquet(f"{d}/supplier.parquet").join(dim, F.col("s_nationkey") == F.col("nation")).select("name", "parent", (F.col("s_suppkey") % 1000).alias("population"), F.lit(1e6).alias("area_m2"), _pick("s_suppkey", *_GEO).alias("geo"))
    outlets = frame(spark, d, "outlets")
    sums = [F.count(F.lit(1)).alias("outlets"), F.count_distinct("rep").alias("reps"), F.sum("value").alias("value")]
    placed = spatial.inside(outlets, polygons(spark, d).select("key", "pos", "rings"), how="first").where("key IS NOT NULL").groupBy(F.col("key").alias("nation")).agg(*sums).join(dim, "nation")
    named = outlets.where("nation % 2 = 0").groupBy("nation").agg(*sums).join(dim, "nation")
    rows = workspace.base_rows(boxes, villages, placed, named)
    return rows.select("key", "n_villages", "population", F.floor(F.col("area_km2") + 0.5).cast("long").alias("area_km2"), F.array_join(F.transform("geo", lambda g: F.concat_ws("=", g["geo"], g["n"].cast("string"))), ",").alias("geo"), "outlets", "reps", "value", "has_data")


@query("flt8_hierarchy_filter", with_("parts") + """ SELECT point_id FROM parts WHERE upper(trim(brand)) = 'BRAND#2' AND upper(trim(category)) LIKE '%TIN' AND upper(trim(category)) = 'STANDARD ANODIZED TIN' OR upper(trim(brand)) = 'BRAND#1'""")
def _(spark, d):
    rows = frame(spark, d, "parts")
    ask = lambda **f: workspace.chosen({"name": None, "size": " ", **f})
    return rows.where(ask(brand=" brand#2", category="Standard Anodized Tin ") | ask(brand="Brand#1")).select("point_id")


_LAYERS = ("kecamatan", "dse_layer", "plain", "microcluster", "kel_desa")
_FILES = ("site_dse_mapping.kmz", "Service Point.kmz", "BTS list.kmz", "mc36_all.kmz", "tmpb8.kmz", None, "City Border.kmz")


@query("flt11_visible_layers", f"""WITH l AS (SELECT n_nationkey AS id, {_case('n_nationkey', *_LAYERS)} AS layer, {_case('n_nationkey', *_FILES)} AS file FROM nation),
 r AS (SELECT id, CASE WHEN layer = 'kecamatan' THEN 'kec' WHEN layer = 'microcluster' THEN 'mc' WHEN file LIKE 'site_dse%' THEN 'outlet' WHEN file LIKE 'Service%' THEN 'service' WHEN file LIKE 'BTS%' THEN 'site' WHEN file LIKE 'mc36%' THEN 'mc' WHEN file LIKE 'City%' THEN 'kec'
 WHEN layer = 'dse_layer' THEN 'outlet' WHEN layer = 'kel_desa' THEN 'desa' ELSE 'other' END AS role FROM l)
SELECT id, role, role IN ('mc', 'kec', 'desa', 'service', 'other') AS gapura, role IN ('mc', 'kec', 'desa', 'outlet', 'site', 'other') AS distribution, role IN ('mc', 'kec', 'desa') AS baseline, true AS unknown FROM r""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), _pick("n_nationkey", *_LAYERS).alias("layer"), _pick("n_nationkey", *_FILES).alias("file"))
    see = {k: workspace.visible(k, F.col("layer"), F.col("file")) for k in ("gapura", "distribution", "baseline", "unknown")}
    return rows.select("id", workspace.role(F.col("layer"), F.col("file")).alias("role"), *[c.alias(k) for k, c in see.items()])


@query("flt12_search", with_("outlets") + """ SELECT point_id FROM outlets WHERE nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND contains(regexp_replace(upper(point_id || name || brand), '[^A-Z0-9]', '', 'g'), '7BUIL') ORDER BY point_id LIMIT 300""")
def _(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    rows = frame(spark, d, "outlets").join(nation.select(F.col("n_nationkey").alias("nation"), F.concat(F.lit(" "), F.lower("n_name")).alias("district")), "nation")
    return workspace.searched(rows, "7 buil", ["point_id", "name", "brand"], nation.where("n_regionkey = 1").select(F.col("n_name").alias("district"))).select("point_id")


@query("flt16_boundary_kinds", """WITH k AS (SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'desa' WHEN 1 THEN 'mc36' WHEN 2 THEN 'mcagus' WHEN 3 THEN 'kecamatan' ELSE 'unknown' END AS kind FROM nation)
SELECT id, kind, CASE kind WHEN 'mcagus' THEN 'replaces the primary cut' WHEN 'unknown' THEN 'no field tells a boundary' WHEN 'desa' THEN 'belongs in another slot: desa' WHEN 'kecamatan' THEN 'belongs in another slot: kecamatan' END AS refused FROM k""")
def _(spark, d):
    sets = [["kel_des", "KEC", "KABKOT"], ["MC36", "KEC", "KABKOT"], ["mc_ioh"], ["KABKOT", "Kec"], ["KEC", "name"]]
    fields = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in sets]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    kind = workspace.boundary_kind(fields)
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), kind.alias("kind"), workspace.refused(kind, ["mc36"]).alias("refused"))


_NAMES, _FOLDERS = ("GraPARI Bekasi", "DRYNA CELL", "XL Center", "Toko Baru", "3 Store", "Smartfren", "Ponsel Jaya"), ("Peta", "IPP Bekasi", None, "Konter")


@query("src33_service_import", f"""WITH f AS (SELECT c_custkey AS seq, {_case('c_custkey', *_NAMES)} AS name, {_case('c_custkey', *_FOLDERS)} AS folder, CAST(c_custkey % 3 AS DOUBLE) AS lat, CAST(c_custkey % 5 + 100 AS DOUBLE) AS lon FROM customer),
 o AS (SELECT *, lower(concat_ws(' ', folder, name)) AS t FROM f), p AS (SELECT *, CASE WHEN regexp_matches(t, 'grapari') THEN 'TSEL' WHEN regexp_matches(t, '\\bxl\\b') THEN 'XL' WHEN regexp_matches(t, 'smartfren') THEN 'SF' WHEN regexp_matches(t, '\\b3\\s?store\\b') THEN '3ID' ELSE 'OTHER' END AS told FROM o),
 q AS (SELECT *, coalesce(regexp_matches(lower(folder), '\\bipp\\b|konter'), false) OR told = 'OTHER' AND regexp_matches(lower(name), '\\bcell\\b|\\bponsel\\b') AS counter, 'sp:' || substr(sha1(lower(name) || '|' || printf('%.6f', lat) || '|' || printf('%.6f', lon)), 1, 20) AS key FROM p),
 n AS (SELECT key, CASE WHEN counter THEN 'IPP' ELSE told END AS operator, CASE WHEN counter THEN 'outlet' WHEN told = 'OTHER' THEN 'unknown' ELSE 'operator' END AS class, name, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM q) WHERE r = 1)
SELECT * FROM n UNION ALL SELECT 'store:' || s_suppkey, 'IM3', 'operator', s_name, CAST(1 AS DOUBLE), CAST(2 AS DOUBLE) FROM supplier WHERE s_suppkey % 3 = 0""")
def _(spark, d):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("seq"), F.lit(None).cast("string").alias("raw"), _pick("c_custkey", *_FOLDERS).alias("folder"), _pick("c_custkey", *_NAMES).alias("name"), F.lit(None).cast("string").alias("kind"), (k % 3).cast("double").alias("lat"), (k % 5 + 100).cast("double").alias("lon"))
    old = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "store:").otherwise("file.kml#"), "s_suppkey").alias("key"), F.lit("IM3").alias("operator"), F.lit("operator").alias("class"), F.col("s_name").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return workspace.imported(rows, old)


@query("snk21_seeded_stores", with_("sites") + """ SELECT 'store:' || point_id AS key, name, CASE WHEN point_id % 5 = 0 THEN 'TSEL' ELSE 'IM3' END AS operator FROM sites UNION ALL SELECT 'sp:1', 'kept', 'XL'""")
def _(spark, d):
    sites = frame(spark, d, "sites")
    stores = sites.select(F.col("point_id").alias("store"), "name", "lon", F.when(F.col("point_id") % 5 != 0, F.col("lat")).alias("lat"))
    old = sites.where("point_id % 2 = 1 OR point_id % 5 = 0").select(F.concat(F.lit("store:"), "point_id").alias("key"), F.lit("TSEL").alias("operator"), F.lit("operator").alias("class"), "name", "lat", "lon")
    old = old.union(spark.range(1).select(F.lit("sp:1"), F.lit("XL"), F.lit("operator"), F.lit("kept"), F.lit(0.0), F.lit(0.0)))
    once = workspace.seeded(stores, old)
    return workspace.seeded(stores, once).select("key", "name", "operator")


@query("join29_stamped_sites", with_("outlets", "sites", "boxes") + f""", s AS (SELECT o.*, CAST(point_id % 25 AS BIGINT) AS rep, (SELECT min(b.key) FROM boxes b WHERE {IN_BOX}) AS village FROM sites o),
 n AS (SELECT point_id, arg_min(near_rep, (m, id)) AS near_rep FROM (SELECT o.point_id, p.point_id AS id, p.rep AS near_rep, {METRES} AS m FROM s o, outlets p) GROUP BY point_id)
SELECT point_id, CASE WHEN village % 2 = 0 THEN village ELSE near_rep END AS assigned, CASE WHEN village % 2 = 0 THEN 'polygon' ELSE 'nearest' END AS mode, village, rep <> CASE WHEN village % 2 = 0 THEN village ELSE near_rep END AS mismatch FROM s JOIN n USING (point_id)""")
def _(spark, d):
    shape = polygons(spark, d)
    sites = frame(spark, d, "sites").withColumn("rep", F.col("point_id") % 25)
    rows = workspace.stamped(sites, shape.where("key % 2 = 0").withColumn("key", F.col("key").cast("long")), frame(spark, d, "outlets"), shape)
    return rows.select("point_id", "assigned", "mode", "village", "mismatch")


_FILTERED = """, h AS (SELECT upper(name) AS d, CASE WHEN key % 2 = 0 THEN 'R' || region ELSE '' END AS c, 'M' || key % 4 AS mc FROM boxes),
 o AS (SELECT 'outlet' AS cls, 'o' || point_id AS id, upper(b.name) AS district, CASE WHEN point_id % 3 = 0 THEN 'X' ELSE 'R' || b.region END AS city, o.lon, CASE WHEN point_id % 50 = 0 THEN 80 ELSE o.lat END AS lat FROM outlets o JOIN boxes b ON b.key = o.nation),
 s0 AS (SELECT o.point_id AS seq, CASE WHEN o.point_id % 10 <> 0 THEN o.point_id % 400 END AS site, CASE WHEN o.point_id % 3 <> 0 THEN upper(b.name) ELSE '' END AS district, CASE WHEN o.point_id % 3 <> 0 THEN 'R' || b.region ELSE '' END AS city, o.lon, o.lat FROM sites o JOIN boxes b ON b.key = o.point_id % 25),
 s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) AS r FROM s0) WHERE site IS NULL OR r = 1),
 s2 AS (SELECT o.*, b.name AS bd, b.region AS br FROM s1 o LEFT JOIN boxes b ON {box}),
 s AS (SELECT 'site' AS cls, 's' || seq AS id, CASE WHEN district = '' THEN upper(bd) ELSE district END AS district, CASE WHEN district = '' THEN 'R' || br ELSE city END AS city, lon, lat FROM s2 WHERE district <> '' OR bd IS NOT NULL),
 g AS (SELECT 'site' AS cls, 'g' || point_id AS id, upper(b.name) AS district, 'R' || b.region AS city, CAST(107 AS DOUBLE) AS lon, CAST(-6 AS DOUBLE) AS lat FROM parts JOIN boxes b ON b.key = point_id % 25 WHERE point_id % 500 NOT IN (SELECT site FROM s0 WHERE site IS NOT NULL)),
 p AS (SELECT 'poi' AS cls, 'p' || point_id AS id, CASE WHEN point_id % 2 = 0 THEN upper(b.name) ELSE '' END AS district, '' AS city, CAST(107 AS DOUBLE) AS lon, CAST(-6 AS DOUBLE) AS lat FROM parts JOIN boxes b ON b.key = point_id % 25),
 u AS (SELECT * FROM o UNION ALL SELECT * FROM s UNION ALL SELECT * FROM g UNION ALL SELECT * FROM p),
 k AS (SELECT u.*, CASE WHEN a.d IS NOT NULL THEN a.mc ELSE b.mc END AS mc, a.d IS NOT NULL OR b.d IS NOT NULL AS in_territory FROM u LEFT JOIN h a ON a.d = u.district AND a.c = u.city LEFT JOIN h b ON b.d = u.district AND b.c = '' WHERE lat < 80)
SELECT cls, id, district, city, in_territory FROM k WHERE mc = 'M1'"""


@query("join32_all_points", with_("outlets", "sites", "parts", "boxes") + _FILTERED.replace("{box}", IN_BOX))
def _(spark, d):
    boxes = frame(spark, d, "boxes").select(F.col("key").alias("box"), F.col("name").alias("district"), F.concat(F.lit("r"), "region").alias("city"))
    k = F.col("point_id")
    named = lambda t, on: t.join(boxes, on == F.col("box")).drop("name")
    outlets = named(frame(spark, d, "outlets"), F.col("nation")).select(F.concat(F.lit("o"), k).alias("id"), F.lit("n").alias("name"), "district", F.when(k % 3 == 0, "x").otherwise(F.col("city")).alias("city"), "lon", F.when(k % 50 == 0, 80.0).otherwise(F.col("lat")).alias("lat"))
    sites = named(frame(spark, d, "sites"), k % 25).select(k.alias("seq"), F.when(k % 10 != 0, k % 400).alias("site"), F.concat(F.lit("s"), k).alias("id"), F.lit("n").alias("name"), F.when(k % 3 != 0, F.col("district")).alias("district"), F.when(k % 3 != 0, F.col("city")).alias("city"), "lon", "lat")
    parts = named(frame(spark, d, "parts"), k % 25)
    registry = parts.select((k % 500).alias("site"), F.concat(F.lit("g"), k).alias("id"), F.lit("n").alias("name"), "district", "city", F.lit(107.0).alias("lon"), F.lit(-6.0).alias("lat"))
    pois = parts.select(F.concat(F.lit("p"), k).alias("id"), F.lit("n").alias("name"), F.when(k % 2 == 0, F.col("district")).alias("district"), F.lit(" ").alias("city"), F.lit(107.0).alias("lon"), F.lit(-6.0).alias("lat"))
    tree = boxes.select("district", F.when(F.col("box") % 2 == 0, F.col("city")).alias("city"), F.concat(F.lit("M"), F.col("box") % 4).alias("mc"), F.lit("b").alias("branch"), F.lit("a").alias("area"))
    shapes = polygons(spark, d).select(F.col("name").alias("key"), F.concat(F.lit("R"), "region").alias("parent"), "pos", "rings")
    rows = workspace.all_points(outlets, sites, registry, pois, tree, {"mc": "m1 ", "area": None}, shapes)
    return rows.select("cls", "id", "district", "city", "in_territory")


@query("join33_coloured_groups", with_("boxes") + """, g AS (SELECT key, CASE WHEN key % 6 = 5 THEN '(no value)' ELSE 'R' || region END AS grp FROM boxes), f AS (SELECT grp, row_number() OVER (ORDER BY min(key)) - 1 AS no FROM g GROUP BY grp),
 h AS (SELECT *, (CAST(no AS DOUBLE) * CAST(137.508 AS DOUBLE)) % CAST(360 AS DOUBLE) AS hue FROM f), c AS (SELECT *, CAST('0.62' AS DOUBLE) * CAST('0.9' AS DOUBLE) AS chroma FROM h),
 x AS (SELECT grp, no, list_transform([0.0, 4.0, 2.0], lambda s: floor((greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), abs((hue / 60 + s) % 6 - 3) - 1)) * chroma + CAST('0.55' AS DOUBLE) - chroma / 2) * 255 + 0.5)) AS v FROM c)
SELECT key, grp, no AS group_no, '#' || lower(printf('%02x', CAST(v[1] AS BIGINT)) || printf('%02x', CAST(v[2] AS BIGINT)) || printf('%02x', CAST(v[3] AS BIGINT))) AS colour FROM g JOIN x USING (grp)""")
def _(spark, d):
    rows = frame(spark, d, "boxes").select("key", "pos", F.when(F.col("key") % 6 != 5, F.concat(F.lit(" R"), "region")).otherwise(" ").alias("field"))
    return workspace.coloured(rows, "field").select("key", F.col("group").alias("grp"), F.col("group_no").cast("long").alias("group_no"), "colour")


@query("agg24_dashboard_checks", with_("outlets") + """, o AS (SELECT *, CASE WHEN point_id % 9 <> 0 THEN rep END AS r FROM outlets), t AS (SELECT 'district: ' || nation AS what, count(*) AS n FROM o GROUP BY nation ORDER BY n DESC, CAST(nation AS VARCHAR) LIMIT 8)
SELECT * FROM t UNION ALL SELECT 'villages without outlet', count(*) FROM (SELECT n_nationkey AS nation, CAST(v AS BIGINT) AS village FROM nation, range(15) r(v)) x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.nation = x.nation AND o.village = x.village)
UNION ALL SELECT 'outlets', count(*) FROM o UNION ALL SELECT 'flagged', count(*) FILTER (WHERE value < 0) FROM o UNION ALL SELECT 'no_rep', count(*) FILTER (WHERE r IS NULL) FROM o UNION ALL SELECT 'mean_x10', CAST(floor(count(*) * CAST(10 AS DOUBLE) / count(DISTINCT r) + 0.5) AS BIGINT) FROM o""")
def _(spark, d):
    rows = frame(spark, d, "outlets").withColumns({"rep": F.when(F.col("point_id") % 9 != 0, F.col("rep")), "nation": F.col("nation").cast("string")})
    villages = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("nation"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("village"))
    return workspace.checks(rows, villages, "nation", ["nation", "village"], "rep", F.col("value") < 0)


@query("agg34_derived_steps", with_("parts") + """ SELECT 'mc' AS step, count(*) FILTER (WHERE size % 3 = 0) AS n, count(*) FILTER (WHERE size % 3 = 0) > 0 AS done FROM parts UNION ALL SELECT 'rep', 0, false UNION ALL SELECT 'differ', count(*) FILTER (WHERE size % 3 = 0 AND size % 6 <> 0), count(*) FILTER (WHERE size % 3 = 0 AND size % 6 <> 0) > 0 FROM parts""")
def _(spark, d):
    rows = frame(spark, d, "parts").select(F.when(F.col("size") % 3 == 0, F.col("brand")).otherwise("").alias("mc"), F.when(F.col("size") % 6 == 0, F.col("brand")).when(F.col("size") % 3 == 0, "other").alias("mc36"), F.lit(None).cast("string").alias("rep"))
    return workspace.derived(rows.withColumn("mc", F.nullif("mc", F.lit(""))), {"mc": "mc", "rep": "rep"}, ("mc", "mc36"))


@query("agg35_tallies", with_("parts") + """ SELECT * FROM (SELECT 'operator' AS what, brand AS name, CASE WHEN bool_or(size % 2 = 0) THEN 'outlet' ELSE 'operator' END AS class, count(*) AS n FROM parts GROUP BY brand) UNION ALL SELECT * FROM (SELECT 'category', category, NULL, count(*) AS n FROM parts WHERE size > 10 GROUP BY category ORDER BY n DESC, category LIMIT 40)""")
def _(spark, d):
    rows = frame(spark, d, "parts").select(F.col("brand").alias("operator"), F.when(F.col("size") % 2 == 0, "outlet").alias("class"), F.when(F.col("size") > 10, F.col("category")).alias("category"))
    tally = workspace.operator_tally(rows).select(F.lit("operator").alias("what"), F.col("operator").alias("name"), "class", "n")
    return tally.union(workspace.top_categories(rows).select(F.lit("category"), "category", F.lit(None).cast("string"), "n"))


@query("flt6_scope", with_("boxes") + """ SELECT key, upper(trim(name)) NOT IN ('CHINA', 'FRANCE') AS outside, upper(trim(name)) IN ('CHINA', 'FRANCE') AS kept FROM boxes""")
def _(spark, d):
    rows, wanted = frame(spark, d, "boxes").select("key", F.concat(F.lit(" "), F.lower("name")).alias("province")), ["China", " france"]
    kept = workspace.scoped(rows, "province", wanted, True).select("key", F.lit(True).alias("kept"))
    return workspace.scoped(rows, "province", wanted, False).join(kept, "key", "left").select("key", "outside", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("flt10_admitted", with_("outlets", "boxes") + """ SELECT point_id, nation % 3 = 0 AS outside FROM outlets WHERE nation % 3 = 0 OR nation IN (SELECT key FROM boxes WHERE key % 3 <> 0 AND region = 1)""")
def _(spark, d):
    boxes = frame(spark, d, "boxes").select("key", "region", F.col("name").alias("district"))
    rows = frame(spark, d, "outlets").join(boxes.select(F.col("key").alias("nation"), F.lower("district").alias("district")), "nation")
    territory = boxes.where("key % 3 <> 0")
    return workspace.admitted(rows, territory.where("region = 1"), territory, "district").select("point_id", "outside")


@query("agg18_village_stats", with_("sites", "boxes") + """, v AS (SELECT DISTINCT point_id % 25 AS d, point_id % 200 AS village FROM sites), s AS (SELECT point_id % 150 AS village, count(*) AS n FROM sites GROUP BY 1),
 r AS (SELECT v.village, 'M' || b.region AS mc, coalesce(s.n, 0) AS sites, v.village * 10 AS population FROM v JOIN boxes b ON b.key = v.d LEFT JOIN s USING (village))
SELECT 'village' AS level, CAST(village AS VARCHAR) AS name, 1 AS villages, sites, population, 2 AS area_km2 FROM r UNION ALL SELECT 'mc', mc, count(*), CAST(sum(sites) AS BIGINT), CAST(sum(population) AS BIGINT), 2 * count(*) FROM r GROUP BY mc""")
def _(spark, d):
    k = F.col("point_id")
    boxes = frame(spark, d, "boxes")
    sites = frame(spark, d, "sites")
    villages = sites.select((k % 25).alias("d"), (k % 200).alias("village")).distinct().join(boxes.select(F.col("key").alias("d"), F.lower("name").alias("district")), "d")
    villages = villages.select("village", "district", (F.col("village") * 10).alias("population"), F.lit(2e6).alias("area_m2"))
    each, mc = workspace.village_stats(villages, sites.select((k % 150).alias("village")), boxes.select(F.col("name").alias("district"), F.concat(F.lit("M"), "region").alias("mc")))
    long = lambda t, level, name, n: t.select(F.lit(level).alias("level"), F.col(name).cast("string").alias("name"), n.cast("long").alias("villages"), "sites", "population", F.floor(F.col("area_km2") + 0.5).cast("long").alias("area_km2"))
    return long(each, "village", "village", F.lit(1)).union(long(mc, "mc", "mc", F.col("villages")))
