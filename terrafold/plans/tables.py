"""Queries over aggregates, joins on keys, sets and sinks (§2.2, 2.5, 2.6, 2.7 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions import text
from terrafold.operators import facets, resolve, territory
from terrafold.sources import sinks

from .fixtures import METRES, frame, with_
from .registry import query


def _k(c, scale=1000):
    return F.floor(c * float(scale) + 0.5).cast("long")


_NAMED = """SELECT o.*, n.n_name AS branch, r.r_name AS area FROM outlets o JOIN nation n ON n.n_nationkey = o.nation JOIN region r ON r.r_regionkey = n.n_regionkey"""


def _named(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    dim = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("branch"), F.col("r_name").alias("area"))
    return frame(spark, d, "outlets").join(dim, "nation")


@query("agg8_agg9_rollup", with_("outlets") + f""", t AS ({_NAMED}), e AS (
 SELECT 'all' AS level, '' AS key, * FROM t UNION ALL SELECT 'area', area, * FROM t UNION ALL SELECT 'branch', area || ' > ' || branch, * FROM t UNION ALL SELECT 'village', area || ' > ' || branch || ' > ' || village, * FROM t)
SELECT level, key, count(*) AS outlets, count(DISTINCT rep) AS reps, CAST(sum(value) AS BIGINT) AS value, CAST(floor(CAST(sum(share * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS share FROM e GROUP BY level, key""")
def _(spark, d):
    rows = territory.rolled_up(_named(spark, d), ["area", "branch", "village"])
    return rows.select("level", "key", "outlets", "reps", "value", _k(F.col("share")).alias("share"))


@query("agg1_facets", with_("parts") + """ SELECT brand AS value, count(*) AS n FROM parts WHERE trim(brand) <> '' GROUP BY brand ORDER BY n DESC, value LIMIT 300""")
def _(spark, d):
    return facets.facet(frame(spark, d, "parts"), "brand")


@query("agg2_flt2_buckets", with_("sites") + """ SELECT count(*) FILTER (WHERE kind = 'atm') AS atm, count(*) FILTER (WHERE kind = 'bank') AS bank, CAST(NULL AS BIGINT) AS fuel FROM sites""")
def _(spark, d):
    return facets.buckets(frame(spark, d, "sites"), {"atm": F.col("kind") == "atm", "bank": F.col("kind") == "bank", "fuel": None})


@query("agg3_completeness", with_("parts") + """, p AS (SELECT brand, CASE WHEN size % 3 = 0 THEN NULL ELSE name END AS name, CASE WHEN size > 40 THEN category END AS category FROM parts),
 c AS (SELECT brand, count(*) AS n, count(name) AS name, count(category) AS category FROM p GROUP BY brand)
SELECT brand, n, field, filled, CAST(floor(CAST(filled AS DOUBLE) * 1000 / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS permille FROM (SELECT brand, n, 'name' AS field, name AS filled FROM c UNION ALL SELECT brand, n, 'category', category FROM c)""")
def _(spark, d):
    rows = frame(spark, d, "parts").select("brand", F.when(F.col("size") % 3 != 0, F.col("name")).alias("name"), F.when(F.col("size") > 40, F.col("category")).alias("category"))
    return facets.completeness(rows, ["name", "category"], "brand")


@query("agg4_agg33_conditional_sums", with_("outlets") + """ SELECT nation, count(*) FILTER (WHERE brand = 'BUILDING') AS own, count(*) FILTER (WHERE brand = 'MACHINERY') AS comp, CASE WHEN count(*) FILTER (WHERE brand IN ('BUILDING', 'MACHINERY')) > 0
 THEN CAST(floor(CAST(count(*) FILTER (WHERE brand = 'BUILDING') AS DOUBLE) / CAST(count(*) FILTER (WHERE brand IN ('BUILDING', 'MACHINERY')) AS DOUBLE) * 1000 + 0.5) AS BIGINT) END AS sov FROM outlets GROUP BY nation""")
def _(spark, d):
    from terrafold.operators.siting import densities

    rows = frame(spark, d, "outlets").groupBy("nation").agg(F.count_if(F.col("brand") == "BUILDING").alias("own_stores"), F.count_if(F.col("brand") == "MACHINERY").alias("comp_stores"))
    rows = densities(rows.withColumns({"ms_ioh": F.lit(0.5), "area_km2": F.lit(100.0)}), ["own_stores"])
    return rows.select("nation", F.col("own_stores").alias("own"), F.col("comp_stores").alias("comp"), _k(F.col("retail_sov")).alias("sov"))


@query("agg5_latest_period", with_("metrics") + """ SELECT entity, metric, max(period) AS period, max(value) FILTER (WHERE period = top) AS value FROM (SELECT *, max(period) OVER (PARTITION BY entity, metric) AS top FROM metrics) GROUP BY entity, metric""")
def _(spark, d):
    return territory.latest(frame(spark, d, "metrics"), "entity", "metric")


@query("agg6_weighted_share", with_("outlets") + """ SELECT brand, CAST(floor(CAST(sum(share * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS share FROM outlets GROUP BY brand""")
def _(spark, d):
    return frame(spark, d, "outlets").groupBy("brand").agg(_k(territory.weighted_share(F.col("share"), F.col("weight"))).alias("share"))


@query("agg13_agg14_win9_roster", with_("outlets") + """, l AS (SELECT nation, rep, brand, count(*) AS n FROM outlets GROUP BY ALL), t AS (SELECT nation, rep, string_agg(brand, ',' ORDER BY n DESC, brand) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY nation, rep ORDER BY n DESC, brand) AS r FROM l) WHERE r <= 3 GROUP BY nation, rep),
 e AS (SELECT nation, rep, count(*) AS outlets, count(DISTINCT village) AS places FROM outlets GROUP BY nation, rep), w AS (SELECT nation, count(*) AS whole FROM outlets GROUP BY nation)
SELECT nation, rep, outlets, places, top3, CAST(floor(CAST(outlets AS DOUBLE) * 1000 / CAST(whole AS DOUBLE) + 0.5) AS BIGINT) AS permille FROM e JOIN t USING (nation, rep) JOIN w USING (nation)""")
def _(spark, d):
    return territory.roster(frame(spark, d, "outlets"), "nation", "rep", "village", "brand").select("nation", "rep", "outlets", "places", "top3", "permille")


@query("agg15_majority", with_("outlets") + """, s AS (SELECT nation, brand, CAST(sum(weight) AS BIGINT) AS weight FROM outlets GROUP BY ALL) SELECT nation, brand, weight FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY weight DESC, brand) AS r FROM s) WHERE r = 1""")
def _(spark, d):
    return territory.majority(frame(spark, d, "outlets"), "nation", "brand", F.col("weight")).select("nation", "brand", "weight")


@query("agg16_set3_agreement", with_("outlets") + """, a AS (SELECT rep, min(nation) AS x FROM outlets GROUP BY rep), b AS (SELECT rep, max(nation) AS y FROM outlets GROUP BY rep) SELECT count(*) AS n_both, count(*) FILTER (WHERE x <> y) AS n_differ FROM a JOIN b USING (rep)""")
def _(spark, d):
    rows = frame(spark, d, "outlets")
    return territory.agreement(rows.groupBy("rep").agg(F.min("nation").alias("nation")), rows.groupBy("rep").agg(F.max("nation").alias("nation")), "rep", "nation")


@query("agg17_tree", with_("outlets") + f""", t AS ({_NAMED}), v AS (SELECT area, branch, brand, village, count(*) AS n FROM t GROUP BY ALL)
SELECT area, branch, brand, village, n, CAST(sum(n) OVER (PARTITION BY area, branch, brand) AS BIGINT) AS in_brand, CAST(sum(n) OVER (PARTITION BY area, branch) AS BIGINT) AS in_branch, CAST(sum(n) OVER (PARTITION BY area) AS BIGINT) AS in_area, row_number() OVER (PARTITION BY area, branch, brand ORDER BY village) - 1 AS place FROM v""")
def _(spark, d):
    rows = territory.tree(_named(spark, d), "area", "branch", "brand", "village")
    rows = rows.select("area", F.col("n").alias("in_area"), F.explode("children").alias("b")).select("area", "in_area", F.col("b.name").alias("branch"), F.col("b.n").alias("in_branch"), F.explode("b.children").alias("c"))
    rows = rows.select("*", F.col("c.name").alias("brand"), F.col("c.n").alias("in_brand"), F.posexplode("c.children").alias("place", "v")).withColumn("place", F.col("place").cast("long"))
    return rows.select("area", "branch", "brand", F.col("v.name").alias("village"), F.col("v.n").alias("n"), "in_brand", "in_branch", "in_area", "place")


@query("agg18_join24_metric_join", with_("boxes", "metrics") + """, m AS (SELECT entity % 25 AS key, count(*) AS n FROM metrics GROUP BY 1) SELECT boxes.key, CAST(coalesce(n, 0) AS BIGINT) AS n FROM boxes LEFT JOIN m ON m.key = boxes.key AND boxes.key % 2 = 0""")
def _(spark, d):
    m = frame(spark, d, "metrics").groupBy((F.col("entity") % 25).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    m = m.select(text.alnum_key(F.concat_ws("|", F.lit("Kec"), F.col("k").cast("string"))).alias("norm"), "n")
    boxes = frame(spark, d, "boxes").select("key", text.alnum_key(F.concat(F.when(F.col("key") % 2 == 0, "kec-").otherwise("desa-"), F.col("key").cast("string"))).alias("norm"))
    return boxes.join(m, "norm", "left").select("key", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("agg19_agg31_tally", with_("parts") + """ SELECT CASE WHEN size % 4 = 0 THEN '(blank)' ELSE brand END AS value, count(*) AS n FROM parts GROUP BY 1""")
def _(spark, d):
    return facets.tally(frame(spark, d, "parts"), F.when(F.col("size") % 8 == 0, " ").when(F.col("size") % 4 != 0, F.col("brand")))


@query("agg20_field_model", with_("parts") + """, l AS (SELECT 'brand' AS field, brand AS value FROM parts UNION ALL SELECT 'size', CAST(size AS VARCHAR) FROM parts), c AS (SELECT field, value, count(*) AS n FROM l GROUP BY ALL)
SELECT field, value, n, r AS rank, k AS n_distinct FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY field) AS k FROM c) WHERE r <= 60""")
def _(spark, d):
    rows = facets.field_model(frame(spark, d, "parts"), ["brand", "size"])
    return rows.select("field", "value", "n", F.col("rank").cast("long").alias("rank"), "n_distinct")


@query("agg21_join27_id_conflicts", with_("outlets") + f""", e AS (SELECT code, brand, rep, count(*) AS n FROM outlets GROUP BY ALL), g AS (SELECT code, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT rep) AS n_reps, count(DISTINCT brand) AS n_brands, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_repeat FROM e GROUP BY code),
 f AS (SELECT o.code, max({METRES}) AS m FROM outlets o JOIN outlets p USING (code) GROUP BY o.code)
SELECT CAST(code AS VARCHAR) AS code, n_rows, n_reps, n_brands, n_repeat, CASE WHEN n_reps > 1 THEN CAST(floor(m + 0.5) AS BIGINT) END AS metres, CASE WHEN n_reps > 1 THEN CASE WHEN n_brands < 2 THEN 'conflict' WHEN m <= 500 THEN 'same place' ELSE 'different place' END END AS kind FROM g JOIN f USING (code) WHERE n_reps > 1 OR n_repeat > 0""".replace("FROM outlets o JOIN outlets p", "FROM t o JOIN t p").replace("FROM outlets GROUP BY ALL", "FROM t GROUP BY ALL").replace(", e AS (", f", t AS (SELECT CASE WHEN point_id % 2 = 0 THEN point_id // 4 ELSE 1000000 + point_id // 40 END AS code, CASE WHEN point_id % 3 = 0 THEN 'x' ELSE brand END AS brand, rep // 30 AS rep, CASE WHEN point_id % 2 = 0 THEN CAST(106.8 AS DOUBLE) + CAST(point_id % 7 AS DOUBLE) / 2000 ELSE lon END AS lon, CASE WHEN point_id % 2 = 0 THEN CAST(-6.2 AS DOUBLE) ELSE lat END AS lat FROM outlets), e AS (", 1))
def _(spark, d):
    k, near = F.col("point_id"), F.col("point_id") % 2 == 0
    code = F.when(near, F.floor(k / 4)).otherwise(F.floor(k / 40) + 1000000).cast("long")
    rows = frame(spark, d, "outlets").select(code.alias("code"), F.when(k % 3 == 0, "x").otherwise(F.col("brand")).alias("brand"), F.floor(F.col("rep") / 30).alias("rep"), F.when(near, F.lit(106.8) + (k % 7).cast("double") / 2000).otherwise(F.col("lon")).alias("lon"), F.when(near, -6.2).otherwise(F.col("lat")).alias("lat"))
    found = territory.id_conflicts(rows, "code", "rep", "brand")
    return found.select("code", "n_rows", "n_reps", "n_brands", "n_repeat", _k(F.col("far_m"), 1).alias("metres"), "kind")


@query("agg22_slabs", with_("outlets") + """, v AS (SELECT rep, count(DISTINCT village) AS n FROM outlets GROUP BY rep), h AS (SELECT rep, nation FROM (SELECT rep, nation, row_number() OVER (PARTITION BY rep ORDER BY count(*) DESC, nation) AS r FROM outlets GROUP BY rep, nation) WHERE r = 1), w AS (SELECT nation, min(brand) AS brand FROM outlets GROUP BY nation)
SELECT brand, CASE WHEN n <= 3 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '4-5' WHEN n <= 7 THEN '6-7' WHEN n <= 10 THEN '8-10' ELSE '>10' END AS slab, count(*) AS reps, CAST(sum(n) AS BIGINT) AS assignments FROM v JOIN h USING (rep) JOIN w USING (nation) GROUP BY 1, 2""")
def _(spark, d):
    return territory.slabs(frame(spark, d, "outlets"), "rep", "village", "nation", "brand")


@query("agg28_bounds", with_("outlets") + """ SELECT nation, CAST(floor(min(lon) * 100000 + 0.5) AS BIGINT) AS w, CAST(floor(max(lat) * 100000 + 0.5) AS BIGINT) AS n FROM outlets GROUP BY nation""")
def _(spark, d):
    return territory.bounds(frame(spark, d, "outlets"), "nation").select("nation", _k(F.col("min_lon"), 100000).alias("w"), _k(F.col("max_lat"), 100000).alias("n"))


@query("agg29_agg30_audit", with_("parts") + """ SELECT brand, category, size, count(*) AS n, count(*) FILTER (WHERE price > 1000) AS dear FROM parts GROUP BY ALL ORDER BY n DESC, brand, category, size LIMIT 60""")
def _(spark, d):
    rows = frame(spark, d, "parts").groupBy("brand", "category", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") > 1000).alias("dear"))
    return rows.orderBy(F.col("n").desc(), "brand", "category", "size").limit(60)


@query("agg32_flt7_options", with_("outlets") + """ SELECT array_to_string(list_sort(list(DISTINCT brand)), ',') AS options FROM outlets WHERE nation IN (1, 2) AND rep < 20""")
def _(spark, d):
    rows = territory.options(frame(spark, d, "outlets"), "brand", F.col("nation").isin(1, 2) & (F.col("rep") < 20))
    return rows.select(F.array_join("options", ",").alias("options"))


@query("agg36_readiness", """WITH n AS (SELECT 'page ' || n_regionkey AS page, n_name AS layer, n_nationkey % 3 <> 0 AS must FROM nation), h AS (SELECT n_name AS layer FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0))
SELECT page, coalesce(string_agg(layer, ',' ORDER BY layer) FILTER (WHERE must AND layer NOT IN (SELECT layer FROM h)), '') AS missing, coalesce(string_agg(layer, ',' ORDER BY layer) FILTER (WHERE NOT must AND layer NOT IN (SELECT layer FROM h)), '') AS would_help, count(*) FILTER (WHERE must AND layer NOT IN (SELECT layer FROM h)) = 0 AS ready FROM n GROUP BY page""")
def _(spark, d):
    nation, supplier = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "supplier"))
    needs = nation.select(F.concat(F.lit("page "), "n_regionkey").alias("page"), F.col("n_name").alias("layer"), (F.col("n_nationkey") % 3 != 0).alias("must"))
    here = nation.join(supplier.where("s_suppkey % 7 = 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey").select(F.col("n_name").alias("layer"))
    return facets.readiness(needs, here)


@query("agg37_metric_pack", with_("metrics") + """ SELECT entity, metric, string_agg(period || '=' || v, ';' ORDER BY period DESC) AS pack FROM (SELECT entity, metric, period, CAST(max(value) AS VARCHAR) AS v FROM metrics GROUP BY ALL) GROUP BY entity, metric""")
def _(spark, d):
    rows = frame(spark, d, "metrics").groupBy("entity", "metric", "period").agg(F.max("value").alias("v"))
    packs = F.sort_array(F.collect_list(F.struct("period", "v")), asc=False)
    return rows.groupBy("entity", "metric").agg(F.array_join(F.transform(packs, lambda x: F.concat_ws("=", x["period"], x["v"].cast("string"))), ";").alias("pack"))


@query("flt7_flt10_semi", with_("outlets", "boxes") + """ SELECT point_id FROM outlets WHERE nation IN (SELECT key FROM boxes WHERE region = 1)""")
def _(spark, d):
    allowed = frame(spark, d, "boxes").where("region = 1").select(F.col("key").alias("nation"))
    return frame(spark, d, "outlets").join(allowed, "nation", "left_semi").select("point_id")


@query("flt13_grouping_fields", with_("parts") + """, l AS (SELECT 'brand' AS field, brand AS value FROM parts UNION ALL SELECT 'name', name FROM parts UNION ALL SELECT 'one', 'x' FROM parts), g AS (SELECT field, count(DISTINCT value) AS n_values, count(*) AS n_rows FROM l GROUP BY field) SELECT field, n_values FROM g WHERE n_values >= 2 AND n_values <= greatest(3, n_rows // 4)""")
def _(spark, d):
    rows = frame(spark, d, "parts").select(F.col("point_id").alias("row"), F.explode(F.create_map(F.lit("brand"), "brand", F.lit("name"), "name", F.lit("one"), F.lit("x"))).alias("field", "value"))
    return facets.grouping_fields(rows).select("field", "n_values")


@query("flt18_set5_signatures", """ SELECT n_nationkey AS layer, CASE n_nationkey % 3 WHEN 0 THEN 'village' WHEN 1 THEN 'district' END AS kind FROM nation""")
def _(spark, d):
    have = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("DESA"), F.lit("KEC"), F.lit("KAB"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("KEC"), F.lit("KAB"))).otherwise(F.array(F.lit("KAB")))
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("layer"), have.alias("fields"))
    return facets.classified(rows, [("village", ["DESA", "KEC"]), ("district", ["KEC"])]).select("layer", "kind")


@query("join1_exact_links", with_("sites") + """ SELECT 'n' || point_id AS place_id, 'node/' || point_id AS other_id FROM sites WHERE point_id % 2 = 0""")
def _(spark, d):
    rows = frame(spark, d, "sites")
    a = rows.select(F.concat(F.lit("n"), "point_id").alias("place_id"), F.when(F.col("point_id") % 4 == 1, "x9").otherwise(F.concat(F.lit("n"), "point_id")).alias("record"))
    return resolve.exact_links(a, rows.where("point_id % 2 = 0").select(F.concat(F.lit("node/"), "point_id").alias("place_id")))


@query("join14_join15_fallback", with_("outlets", "boxes") + """ SELECT point_id, CASE WHEN nation % 2 = 0 THEN nation ELSE first END AS key FROM outlets JOIN (SELECT region, arg_min(key, CAST(key AS VARCHAR)) FILTER (WHERE key % 2 = 0) AS first FROM boxes GROUP BY region) f ON f.region = (SELECT b.region FROM boxes b WHERE b.key = outlets.nation)""")
def _(spark, d):
    boxes = frame(spark, d, "boxes")
    dim = boxes.where("key % 2 = 0").select(F.col("region").cast("string").alias("name"), F.col("key").cast("string").alias("parent"), "key")
    rows = frame(spark, d, "outlets").join(boxes.select(F.col("key").alias("nation"), "region"), "nation").select("point_id", F.col("region").cast("string").alias("name"), F.col("nation").cast("string").alias("parent"))
    return territory.with_fallback(rows, dim, "name", "parent", "key").select("point_id", "key")


@query("join16_set1_unified", with_("outlets", "sites") + """, u AS (SELECT 'a' AS source, point_id, name, rep % 50 AS cluster FROM outlets UNION ALL SELECT 'b', point_id, CASE WHEN point_id % 2 = 0 THEN name END, point_id % 50 FROM sites),
 t AS (SELECT cluster, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM u GROUP BY cluster)
SELECT cluster, source, point_id AS place_id, n_rows, sources FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE source WHEN 'b' THEN 0 ELSE 1 END, name IS NULL, point_id) AS r FROM u) JOIN t USING (cluster) WHERE r = 1""")
def _(spark, d):
    a = frame(spark, d, "outlets").select(F.lit("a").alias("source"), F.col("point_id").alias("place_id"), "name", (F.col("rep") % 50).alias("cluster"), "brand")
    b = frame(spark, d, "sites").select(F.lit("b").alias("source"), F.col("point_id").alias("place_id"), F.when(F.col("point_id") % 2 == 0, F.col("name")).alias("name"), (F.col("point_id") % 50).alias("cluster"))
    rows = resolve.unified(a.unionByName(b, allowMissingColumns=True), F.when(F.col("source") == "b", 0).otherwise(1))
    return rows.select("cluster", "source", "place_id", "n_rows", "sources")


@query("join17_join31_update", with_("boxes", "outlets") + """ SELECT key, coalesce(top, name) AS mc FROM boxes LEFT JOIN (SELECT nation, max(CASE WHEN nation % 2 = 0 THEN brand END) AS top FROM outlets GROUP BY nation) u ON u.nation = boxes.key""")
def _(spark, d):
    new = frame(spark, d, "outlets").groupBy("nation").agg(F.max(F.when(F.col("nation") % 2 == 0, F.col("brand"))).alias("top"))
    boxes = frame(spark, d, "boxes")
    return boxes.join(new, boxes["key"] == new["nation"], "left").select("key", F.coalesce("top", "name").alias("mc"))


@query("join18_set4_gaps", with_("boxes", "outlets") + """ SELECT key FROM boxes WHERE NOT EXISTS (SELECT 1 FROM outlets WHERE outlets.nation * 2 = boxes.key)""")
def _(spark, d):
    return territory.gaps(frame(spark, d, "boxes"), frame(spark, d, "outlets").select((F.col("nation") * 2).alias("key")), "key").select("key")


@query("snk2_win10_upsert", """ SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN 't2' ELSE 't1' END AS first_seen, CASE WHEN event_id % 2 = 0 THEN 't2' WHEN event_id % 3 = 0 THEN 't2' ELSE 't1' END AS last_seen, CAST(CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS run_id
FROM (SELECT event_id, CAST(floor(value) AS BIGINT) + CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 1 ELSE 0 END AS value FROM events)""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.floor("value").cast("long").alias("value"))
    old = rows.where("event_id % 3 <> 0").select("*", F.lit("t1").alias("first_seen"), F.lit("t1").alias("last_seen"), F.lit(1).cast("long").alias("run_id"))
    new = rows.where("event_id % 2 = 0 OR event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    return sinks.upserted(old, new, ["event_id"], "t2", 2)


@query("snk16_redaction", """ SELECT event_id, 1 AS n_attrs FROM events WHERE event_type <> 'click'""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("layer_key"), F.create_map(F.lit("K"), "props", F.lit("Outlet-ID"), F.col("user_id").cast("string")).alias("attrs"))
    kept = sinks.redacted(rows, spark.createDataFrame([("click",)], "layer_key string"))
    return kept.select("event_id", F.size("attrs").alias("n_attrs"))


@query("snk20_seeding", with_("boxes") + """ SELECT key, CASE WHEN key % 3 = 0 THEN name ELSE 'new ' || name END AS value, CASE WHEN key % 3 = 0 THEN 'kept' WHEN key % 3 = 1 THEN 'corrected' ELSE 'added' END AS change FROM boxes""")
def _(spark, d):
    rows = frame(spark, d, "boxes").select("key", F.col("name").alias("value"))
    return sinks.seeded(rows.where("key % 3 <> 2"), rows.where("key % 3 <> 0").withColumn("value", F.concat(F.lit("new "), "value")), "key", "value")


@query("snk8_geojson", with_("boxes") + """ SELECT key, '{"type":"Feature","properties":{"key":' || key || ',"name":"' || name || '"},"geometry":{"type":"Point","coordinates":[' || key || ',0]}}' AS value FROM boxes""")
def _(spark, d):
    rows = frame(spark, d, "boxes")
    out = sinks.geojson_features(rows, sinks.point_geometry(F.col("key"), F.lit(0)), ["key", "name"])
    return out.select(F.get_json_object("value", "$.properties.key").cast("int").alias("key"), "value")


@query("src15_request_plan", with_("boxes") + """ SELECT CAST(sum(population) * 2 AS BIGINT) AS calls_high, sum(population) * 2 * 0.032 <= 100 AS fits FROM boxes""")
def _(spark, d):
    from terrafold.sources.files import request_plan

    searches = frame(spark, d, "boxes").select("key", F.col("population").alias("cells"), F.lit(1).alias("pages_low"), F.lit(2).alias("pages_high"))
    return request_plan(searches, 0.032, 100.0).select("calls_high", "fits")


@query("src31_file_roles", """ SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'site' WHEN contains(lower(p_type), 'promo') THEN 'outlet' ELSE 'other' END AS role FROM part""")
def _(spark, d):
    from terrafold.sources.files import file_role

    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", file_role(F.col("p_type"), [("steel", "site"), ("promo", "outlet")]).alias("role"))


@query("src34_site_collapse", with_("lines") + """ SELECT code, rep FROM (SELECT code, rep, row_number() OVER (PARTITION BY code ORDER BY order_id, rep) AS r FROM lines) WHERE r = 1""")
def _(spark, d):
    first = frame(spark, d, "lines").groupBy("code").agg(F.min_by("rep", F.struct("order_id", "rep")).alias("rep"))
    return first


@query("win6_key_suffixes", with_("outlets") + """ SELECT point_id, CASE WHEN r > 1 THEN code || '#' || r ELSE CAST(code AS VARCHAR) END AS code FROM (SELECT point_id, code, row_number() OVER (PARTITION BY code ORDER BY point_id) AS r FROM outlets)""")
def _(spark, d):
    return sinks.suffixed(frame(spark, d, "outlets"), "code", ["point_id"]).select("point_id", "code")


@query("prj25_rep_identity", with_("outlets") + """, t AS (SELECT point_id, CASE WHEN point_id % 4 = 0 THEN 'U' || rep WHEN point_id % 4 = 1 THEN 'P' || rep ELSE 'RAYON' || nation || ' · ' || brand END AS id FROM outlets) SELECT point_id, id FROM t""")
def _(spark, d):
    from terrafold.functions.reps import identity

    m = F.col("point_id") % 4
    rows = frame(spark, d, "outlets").select("point_id", F.when(m == 0, F.concat(F.lit("U"), "rep")).when(m == 2, "RAYON 7").otherwise("-").alias("unik"), F.when(m == 1, F.concat(F.lit("P"), "rep", F.lit("-IM3"))).alias("pair"), F.concat(F.lit("RAYON"), "nation").alias("rayon"), F.col("brand").alias("label"))
    return rows.select("point_id", identity(F.col("unik"), F.col("pair"), F.lit(None).cast("string"), F.col("rayon"), F.col("label")).alias("id"))


@query("sample_rejects_src27", with_("outlets") + """ SELECT CASE point_id % 4 WHEN 0 THEN 'no_coords' WHEN 1 THEN 'off_map' ELSE 'ok' END AS reason, count(*) AS n FROM outlets GROUP BY 1""")
def _(spark, d):
    from terrafold.sources.files import with_positions

    m = F.col("point_id") % 4
    rows = frame(spark, d, "outlets").select(F.when(m == 0, "n/a").when(m == 1, "-95,5").otherwise("-6,25").alias("lat"), F.when(m == 1, "195,5").otherwise("106,8").alias("lon"))
    return with_positions(rows).groupBy(F.coalesce("reject", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("win8_lim1_stride", with_("outlets") + """, t AS (SELECT nation, point_id, row_number() OVER (ORDER BY nation, point_id) - 1 AS place, count(*) OVER () AS n FROM outlets) SELECT point_id, place FROM t WHERE place % greatest(1, -((-n) // 500)) = 0""")
def _(spark, d):
    from terrafold.operators.spatial import thinned

    return thinned(frame(spark, d, "outlets"), 500, ["nation", "point_id"]).select("point_id", F.col("place").cast("long").alias("place"))
