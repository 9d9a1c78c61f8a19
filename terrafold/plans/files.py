"""Queries that write tables out and read them back, and the smaller rules of sources and sinks (SRC-1 to 3, 5, 8, 16, 17, 20, 26, 28, 29, 32, SNK-1, 3 to 6, 8, 9, 11, 13, 17, FLT-17, PRJ-12, 28, SCR-6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrafold.functions import text
from terrafold.operators import facets, siting
from terrafold.session import checkpoint_dir
from terrafold.sources import cache, files, sinks, versions, workbooks

from .fixtures import frame, polygons, with_
from .registry import query


def _folder(spark, name):
    """A new folder that the driver and all executors see."""
    return f"{checkpoint_dir(spark)}/files/{name}-{uuid.uuid4().hex[:12]}"


def _k(c, scale=1000):
    return F.floor(c * float(scale) + 0.5).cast("long")


_E6 = "CAST(floor(lat * 1000000 + 0.5) AS BIGINT) AS lat_e6, CAST(floor(lon * 1000000 + 0.5) AS BIGINT) AS lon_e6"


@query("src20_src26_src29_csv", with_("outlets") + f""" SELECT CAST(point_id AS VARCHAR) AS code, CASE WHEN point_id % 3 = 0 THEN name || '; x' ELSE name END AS name, {_E6.replace('lat *', 'CASE WHEN point_id % 10 <> 0 THEN lat END *')} FROM outlets""")
def _(spark, d):
    # separated by semicolons, with decimal commas, quoted names, swapped positions and headers that have synonyms
    k = F.col("point_id")
    comma = lambda c: F.replace(F.format_string("%.8f", c), F.lit("."), F.lit(","))
    swap = k % 7 == 0
    lat = F.when(k % 10 == 0, "n/a").otherwise(comma(F.when(swap, F.col("lon")).otherwise(F.col("lat"))))
    rows = frame(spark, d, "outlets").select(k.alias("Outlet ID (new)"), F.when(k % 3 == 0, F.concat("name", F.lit("; x"))).otherwise(F.col("name")).alias("NAMA"), lat.alias("Latitude"), comma(F.when(swap & (k % 10 != 0), F.col("lat")).otherwise(F.col("lon"))).alias("Long"))
    rows.write.csv(path := _folder(spark, "csv"), header=True, sep=";", escape='"')
    found = files.with_positions(files.read_table(spark, path, {"code": ["outletid"], "name": ["nama", "name"], "lat": ["lat", "latitude"], "lon": ["lon", "long"]}))
    return found.select("code", "name", _k(F.col("lat"), 1e6).alias("lat_e6"), _k(F.col("lon"), 1e6).alias("lon_e6"))


@query("snk6_snk11_snk13_csv", with_("outlets") + """ SELECT point_id, name, nation FROM outlets""")
def _(spark, d):
    sinks.write_csv(frame(spark, d, "outlets").select("point_id", "name", "nation"), path := _folder(spark, "csv"), "nation")
    return spark.read.csv(path, header=True, schema="point_id bigint, name string, nation int")


@query("snk4_snk15_snk19_partitions", with_("outlets") + """ SELECT point_id, CASE WHEN nation % 3 = 0 THEN -1 ELSE value END AS value, nation FROM outlets""")
def _(spark, d):
    rows, path = frame(spark, d, "outlets").select("point_id", "value", "nation"), _folder(spark, "layers")
    sinks.replace_partitions(rows, path, "nation")
    sinks.replace_partitions(rows.where("nation % 3 = 0").withColumn("value", F.lit(-1).cast("long")), path, "nation")
    return spark.read.parquet(path)


@query("snk8_src28_geojson", with_("boxes") + """ SELECT name, CAST(key AS VARCHAR) AS key, CASE WHEN holed THEN 2 ELSE 1 END AS n_rings, CAST(floor(x0 * 1000000 + 0.5) AS BIGINT) AS x0_e6, CAST(floor(y1 * 1000000 + 0.5) AS BIGINT) AS y1_e6 FROM boxes""")
def _(spark, d):
    rows = polygons(spark, d)
    features = sinks.geojson_features(rows, sinks.polygon_geometry(F.col("rings")), ["key", "name"])
    sinks.write_collection(features.withColumn("key", F.get_json_object("value", "$.properties.key").cast("int")), path := _folder(spark, "geojson"), [F.col("key")])
    found = files.read_large_geojson(spark, path)
    ring = F.col("polys")[0]
    return found.select("name", F.col("attrs")["key"].alias("key"), F.size(ring).alias("n_rings"), _k(ring[0][0][0], 1e6).alias("x0_e6"), _k(ring[0][2][1], 1e6).alias("y1_e6"))


@query("snk8_src28_outlet_collection", with_("outlets") + f""" SELECT name, CAST(point_id AS VARCHAR) AS id, {_E6} FROM outlets""")
def _(spark, d):
    rows = frame(spark, d, "outlets").withColumn("id", F.col("point_id").cast("string"))
    square = F.array(F.array(*[F.array(F.col("lon") + a, F.col("lat") + b) for a, b in ((0.0, 0.0), (0.001, 0.0), (0.001, 0.001))]))
    features = sinks.geojson_features(rows, sinks.polygon_geometry(square), ["id", "name"])
    sinks.write_collection(features, path := _folder(spark, "outlets"), [F.col("value")])
    corner = F.col("polys")[0][0][0]
    return files.read_large_geojson(spark, path).select("name", F.col("attrs")["id"].alias("id"), _k(corner[1], 1e6).alias("lat_e6"), _k(corner[0], 1e6).alias("lon_e6"))


@query("snk9_src16_src17_kml", with_("sites") + f""" SELECT name, CAST(point_id AS VARCHAR) AS id, '<' || kind || ' & co>' AS kind, {_E6} FROM sites""")
def _(spark, d):
    rows = frame(spark, d, "sites").withColumns({"id": F.col("point_id"), "folder": F.col("kind"), "kind": F.concat(F.lit("<"), "kind", F.lit(" & co>"))})
    sinks.write_kml(sinks.kml_placemarks(rows, "name", "lon", "lat", "folder", ["id", "kind"]), path := _folder(spark, "kml"), "Sites & more")
    spark.dataSource.register(files.KmlSource)
    paths = [r.f.removeprefix("file://") for r in spark.read.text(path).select(F.input_file_name().alias("f")).distinct().collect()]
    found = spark.read.format("kml").option("paths", ",".join(paths)).load()
    spot = F.col("points")[0]
    return found.select("name", F.col("attrs")["id"].alias("id"), F.col("attrs")["kind"].alias("kind"), _k(spot[1], 1e6).alias("lat_e6"), _k(spot[0], 1e6).alias("lon_e6"))


@query("src1_src3_src5_places", with_("outlets") + f""" SELECT CAST(point_id AS VARCHAR) AS id, name, brand AS category, {_E6} FROM outlets WHERE lon BETWEEN CAST('106.7' AS DOUBLE) AND CAST('107.0' AS DOUBLE) AND lat BETWEEN CAST('-6.5' AS DOUBLE) AND CAST('-6.1' AS DOUBLE)""")
def _(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    rows = frame(spark, d, "outlets").select(F.col("point_id").cast("string").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"), F.struct(F.col("brand").alias("primary")).alias("categories"), F.array(F.struct(F.lit("Jl.").alias("freeform"))).alias("addresses"), F.struct(lon.alias("xmin"), lon.alias("xmax"), lat.alias("ymin"), lat.alias("ymax")).alias("bbox"), F.lit(0.9).alias("confidence"))
    sinks.write_places(rows, path := _folder(spark, "places"), F.col("bbox.xmin"), F.col("bbox.ymin"))
    found = files.places_table(files.within_box(spark.read.parquet(path), (-6.5, 106.7, -6.1, 107.0)))
    return found.select("id", "name", "category", _k(F.col("lat"), 1e6).alias("lat_e6"), _k(F.col("lon"), 1e6).alias("lon_e6"))


@query("src20_src30_loose", with_("outlets") + f""" SELECT how, CAST(point_id AS VARCHAR) AS code, name, {_E6} FROM outlets, (SELECT unnest(['headed', 'bare']) AS how)""")
def _(spark, d):
    # one file with a title and a header below it, one without any; decimal commas and semicolons
    rows, folder = frame(spark, d, "outlets"), _folder(spark, "loose")
    comma = lambda c: F.replace(F.format_string("%.8f", c), F.lit("."), F.lit(","))
    line = F.concat_ws(";", F.col("point_id").cast("string"), "name", comma(F.col("lat")), comma(F.col("lon")))
    lines = rows.repartitionByRange("point_id").sortWithinPartitions("point_id").select(line.alias("value"))
    lines.coalesce(1).write.text(f"{folder}/bare")
    head = spark.createDataFrame([(0, "All outlets;;;"), (1, ""), (2, "Kode;Outlet Name;LATITUDE;Long")], "n int, value string")
    head.union(lines.select(F.lit(3), "value")).coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{folder}/headed")
    synonyms = {"code": ["kode"], "name": ["outletname"], "lat": ["lat", "latitude"], "lon": ["lon", "long"]}
    read = lambda how: files.read_loose(spark, f"{folder}/{how}", synonyms).withColumn("how", F.lit(how))
    found = read("headed").unionByName(read("bare").withColumnRenamed("c0", "code"))
    found = files.with_positions(found)
    return found.select("how", "code", "name", _k(F.col("lat"), 1e6).alias("lat_e6"), _k(F.col("lon"), 1e6).alias("lon_e6"))


@query("src3_target_places", with_("parts") + """ SELECT CAST(point_id AS VARCHAR) AS id, CASE WHEN point_id % 4 = 0 THEN 'Indomaret' WHEN point_id % 4 = 1 THEN 'Alfamart' END AS brand, CAST(round((106 + point_id / CAST(30000 AS DOUBLE)) * 10000000) AS BIGINT) AS lon_e7 FROM parts
WHERE (point_id % 3 = 0 OR point_id % 4 = 0) AND point_id % 7 <> 0 AND point_id % 10 >= 4 AND 106 + point_id / CAST(30000 AS DOUBLE) BETWEEN CAST('106.001' AS DOUBLE) AND CAST('106.05' AS DOUBLE)""")
def _(spark, d):
    k = F.col("point_id")
    lon, lat = 106 + k / 30000.0, F.lit(-6.2)
    name = F.concat(F.when(k % 4 == 0, "Indomaret ").when(k % 4 == 1, "Alfamart ").otherwise("Warung "), F.when(k % 7 == 0, "ATM ").otherwise(""), k.cast("string"))
    rows = frame(spark, d, "parts").select(k.cast("string").alias("id"), F.struct(name.alias("primary")).alias("names"), F.struct(F.when(k % 3 == 0, "convenience_store").otherwise("shop").alias("primary")).alias("categories"), F.array(F.struct(F.lit("Jl.").alias("freeform"))).alias("addresses"), F.struct(lon.alias("xmin"), lon.alias("xmax"), lat.alias("ymin"), lat.alias("ymax")).alias("bbox"), ((k % 10) / 10.0).alias("confidence"))
    sinks.write_places(rows, path := _folder(spark, "targets"), F.col("bbox.xmin"), F.col("bbox.ymin"))
    found = files.target_places(spark.read.parquet(path), (-6.5, 106.001, -6.1, 106.05), ["convenience_store"], name_any="indomaret", name_not=r"\batm\b", least_confidence=0.35)
    return found.select("id", "brand", _k(F.col("lon"), 1e7).alias("lon_e7"))


@query("src8_map_elements", with_("sites") + f""" SELECT CASE WHEN point_id % 2 = 0 THEN 'node/' ELSE 'way/' END || point_id AS place_id, name, CASE WHEN point_id % 3 = 0 THEN 'amenity=' || kind ELSE 'shop=' || kind END AS category, {_E6} FROM sites WHERE point_id % 5 <> 0""")
def _(spark, d):
    k, none = F.col("point_id"), F.lit(None).cast("double")
    node = k % 2 == 0
    spot = F.when(~node & (k % 5 != 0), F.struct("lat", "lon"))
    tags = F.create_map(F.lit("name"), "name", F.when(k % 3 == 0, "amenity").otherwise("shop"), "kind")
    rows = frame(spark, d, "sites").select(F.when(node, "node").otherwise("way").alias("type"), k.alias("id"), F.when(node & (k % 5 != 0), F.col("lat")).otherwise(none).alias("lat"), F.when(node & (k % 5 != 0), F.col("lon")).otherwise(none).alias("lon"), spot.alias("center"), tags.alias("tags"))
    return files.map_elements(rows).select("place_id", "name", "category", _k(F.col("lat"), 1e6).alias("lat_e6"), _k(F.col("lon"), 1e6).alias("lon_e6"))


@query("snk3_metric_upsert", with_("metrics") + """, o AS (SELECT entity, metric, period, max(value) AS value FROM (SELECT entity, metric, CASE WHEN entity % 4 = 0 THEN '' ELSE period END AS period, value FROM metrics WHERE entity % 3 <> 0) GROUP BY ALL), n AS (SELECT entity, metric, period, max(value) + 1 AS value FROM (SELECT entity, metric, CASE WHEN entity % 4 = 0 THEN '' ELSE period END AS period, value FROM metrics WHERE entity % 2 = 0) GROUP BY ALL)
SELECT entity, metric, period, coalesce(n.value, o.value) AS value, CASE WHEN o.value IS NULL THEN 't2' ELSE 't1' END AS first_seen, CASE WHEN n.value IS NULL THEN 't1' ELSE 't2' END AS last_seen FROM o FULL JOIN n USING (entity, metric, period)""")
def _(spark, d):
    rows = frame(spark, d, "metrics").withColumn("period", F.coalesce(F.when(F.col("entity") % 4 != 0, F.col("period")), F.lit("")))
    old = rows.where("entity % 3 <> 0").groupBy("entity", "metric", "period").agg(F.max("value").alias("value")).withColumns({"first_seen": F.lit("t1"), "last_seen": F.lit("t1"), "run_id": F.lit(1).cast("long")})
    new = rows.where("entity % 2 = 0").withColumn("value", F.col("value") + 1)
    return sinks.upserted(old, new, ["entity", "metric", "period"], "t2", 2).drop("run_id")


@query("snk5_run_audit", """ SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'running' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS n_rows FROM orders""")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    ended = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.lit("done").alias("status"), F.col("o_custkey").alias("n_rows"))
    return sinks.run_audit(orders.select(F.col("o_orderkey").alias("run_id")), ended).select("run_id", "status", "n_rows")


@query("snk17_purged_layers", with_("outlets") + """ SELECT brand AS layer_key, count(*) FILTER (WHERE lat > CAST('-6.3' AS DOUBLE)) AS feature_count, count(*) FILTER (WHERE lat > CAST('-6.3' AS DOUBLE)) AS kept FROM outlets GROUP BY brand""")
def _(spark, d):
    kept, counts = sinks.purged(frame(spark, d, "outlets").withColumnRenamed("brand", "layer_key"), F.col("lat") > -6.3)
    return counts.join(kept.groupBy("layer_key").agg(F.count(F.lit(1)).alias("kept")), "layer_key", "left").select("layer_key", "feature_count", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("flt17_found", with_("parts") + """ SELECT point_id, name, category FROM parts WHERE upper(name) = (SELECT upper(min(name)) FROM parts) OR upper(category) = (SELECT upper(min(name)) FROM parts) ORDER BY name, category, point_id LIMIT 1""")
def _(spark, d):
    rows = frame(spark, d, "parts").select("name", "category", "point_id")
    return facets.found(rows, rows.agg(F.lower(F.min("name"))).first()[0], "name", "category", "point_id")


@query("prj12_prj28_keys", """ SELECT c_custkey, upper(replace(c_mktsegment, ' ', '')) || 'É' || c_custkey % 7 AS key, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN upper(c_mktsegment) WHEN 2 THEN 'LAST' END AS told FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{d}/customer.parquet")
    told = text.first_not_blank(F.when(k % 4 == 0, " a ").otherwise("#n/a"), F.when(k % 4 == 1, F.col("c_mktsegment")).otherwise(" - "), F.when(k % 4 == 2, "Last").otherwise("null"))
    return rows.select("c_custkey", text.alnum_key(F.concat("c_mktsegment", F.lit("-é "), k % 7)).alias("key"), told.alias("told"))


@query("scr6_breakdown", with_("parts") + """ SELECT point_id, CASE WHEN size % 3 = 0 THEN '' ELSE 'vlr 50 ' || size * 50 || ';' END || 'pop 30 ' || size % 7 * 30 || ';' AS told FROM parts""")
def _(spark, d):
    rows = frame(spark, d, "parts")
    parts = siting.breakdown({"pop": (F.col("size") % 7).cast("double"), "vlr": F.when(F.col("size") % 3 != 0, F.col("size").cast("double")), "unweighted": F.lit(1.0)}, {"pop": 0.3, "vlr": 0.5, "absent": 0.2})
    line = lambda t: F.concat_ws(" ", t["term"], _k(t["weight"], 100).cast("string"), F.concat(_k(t["points"], 1).cast("string"), F.lit(";")))
    return rows.select("point_id", F.array_join(F.transform(parts, line), "").alias("told"))


@query("src2_src32_snk1_snk12_cache", with_("outlets") + """ SELECT 'first' AS made, point_id, nation FROM outlets WHERE nation = 3 UNION ALL SELECT 'new stamp', point_id, nation FROM outlets WHERE nation = 4 UNION ALL SELECT 'refreshed', point_id, nation FROM outlets""")
def _(spark, d):
    # a second table for the same stamp is the first one; a new stamp or a refresh makes one anew
    rows, folder = frame(spark, d, "outlets").select("point_id", "nation"), _folder(spark, "cache")
    made = lambda stamp, name, refresh=False: cache.cached(spark, folder, stamp, lambda: rows.select(F.lit(name).alias("made"), "point_id", "nation"), refresh)
    made("a", "first")
    layers = f"{folder}-layers"
    made("a", "never made").withColumn("layer_key", F.col("nation")).write.partitionBy("layer_key").parquet(layers)
    made("b", "new stamp")
    whole = made("a", "refreshed", True)
    return cache.layer(spark, layers, "3").select("made", "point_id", "nation").union(made("b", "never made").where("nation = 4")).union(whole)


@query("snk15_snk19_versions", with_("outlets") + """, last AS (SELECT point_id, nation, CASE WHEN point_id % 50 = 0 THEN -value ELSE value END AS value FROM outlets WHERE point_id % 70 <> 1 UNION ALL SELECT -1 - point_id, nation, 0 FROM outlets WHERE point_id % 90 = 0)
SELECT 1 AS version, point_id, nation, value FROM outlets UNION ALL SELECT 3, point_id, nation, value FROM last""")
def _(spark, d):
    # a table, an upsert of corrected and new rows, a deletion; the first version stays what it was
    rows, folder = frame(spark, d, "outlets").select("point_id", "nation", "value"), _folder(spark, "versions")
    versions.create(rows, folder, ["point_id"], 32)
    new = rows.where("point_id % 90 = 0").select((-1 - F.col("point_id")).alias("point_id"), "nation", F.lit(0).cast("long").alias("value"))
    versions.upsert(rows.where("point_id % 50 = 0").withColumn("value", -F.col("value")).union(new), folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    versions.delete(rows.where("point_id % 70 = 1").select("point_id"), folder, schema)
    return versions.read(spark, folder, schema, 1).withColumn("version", F.lit(1)).unionByName(versions.read(spark, folder, schema).withColumn("version", F.lit(3)))


@query("src21_sheet_kinds", """ SELECT n_nationkey AS id, CASE n_nationkey % 9 WHEN 0 THEN 'site' WHEN 1 THEN 'village' WHEN 2 THEN 'hierarchy' WHEN 3 THEN 'district' WHEN 4 THEN 'store' WHEN 5 THEN 'operator' WHEN 6 THEN 'agent' WHEN 7 THEN 'site' END AS kind FROM nation""")
def _(spark, d):
    heads = [["Site ID", "Site Lat", "KECAMATAN", "MC"], ["kel_des", "KEC", " KAB_KOT ", "MC"], ["CIRCLE", "REGION", "AREA", "BRANCH", "MC", "KECAMATAN"], ["MC", "Kecamatan"], ["STORE NAME", "LATITUDE"], ["OPERATOR", "LAT"], ["NIK AGENT"], ["SITE_ID", "LATITUDE", "OPERATOR"], ["STORE NAME"]]
    headers = F.element_at(F.array(*[F.array(*map(F.lit, h)) for h in heads]), (F.col("n_nationkey") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), workbooks.sheet_kind(headers).alias("kind"))


@query("src22_village_profile", """WITH r AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 <> 0 THEN 'Desa ' || c_custkey % 300 END AS village, 'Kec ' || c_custkey % 30 AS district, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'B2' ELSE 'B1' END AS branch, c_custkey * 7 % 5000 AS pop FROM customer),
 k AS (SELECT *, upper(village || '|' || district || '|') AS key, row_number() OVER (PARTITION BY village, district ORDER BY seq DESC) AS n FROM r WHERE village IS NOT NULL AND branch IS NOT NULL)
SELECT key, branch, pop AS population, regexp_replace(key, '[^A-Z0-9]', '', 'g') AS join_key FROM k WHERE n = 1 UNION ALL SELECT CASE WHEN village IS NULL THEN 'unnamed' WHEN branch IS NULL THEN 'outside' ELSE 'kept' END, NULL, count(*), NULL FROM r GROUP BY 1""")
def _(spark, d):
    k = F.col("c_custkey")
    text_ = lambda c: c.cast("string")
    cells = F.create_map(F.lit("KEL_DES"), F.when(k % 11 != 0, F.concat(F.lit(" Desa "), text_(k % 300))).otherwise("#N/A"), F.lit("KEC"), F.concat(F.lit("Kec "), text_(k % 30)), F.lit("KAB_KOT"), F.lit("-"), F.lit("BRANCHAGUS"), F.when(k % 4 == 1, "B2").otherwise(""), F.lit("BRANCH"), F.when(k % 4 != 0, "B1"), F.lit("POPULASI_2"), F.format_number(k * 7 % 5000, 0))
    each, states = workbooks.villages(spark.read.parquet(f"{d}/customer.parquet").select(k.alias("seq"), cells.alias("cells")))
    none = F.lit(None).cast("string")
    return each.select("key", "branch", "population", "join_key").union(states.select("state", none, "n", none))


@query("src22_src24_metrics_sites", """WITH r AS (SELECT s_suppkey AS seq, 'S' || s_suppkey % 70 AS site, s_name AS name, s_suppkey % 9 AS v FROM supplier), l AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq DESC) AS n FROM r WHERE seq % 8 <> 0)
SELECT 'site' AS what, site, name AS told, CAST(-6250 AS BIGINT) AS value FROM l WHERE n = 1 UNION ALL SELECT 'vlr_subs', site, 'MTD 1708', v * 1000 FROM r WHERE v > 0 UNION ALL SELECT 'sso', site, 'FM 1707', 2000 FROM r""")
def _(spark, d):
    k = F.col("s_suppkey")
    cells = F.create_map(F.lit("SITE ID"), F.concat(F.lit("S"), k % 70), F.lit("SITE NAME"), F.col("s_name"), F.lit("LAT"), F.when(k % 8 != 0, "-6,25").otherwise("n/a"), F.lit("LONG"), F.lit("106,8"), F.lit("Vlr Subs MTD 1708"), F.when(k % 9 > 0, F.format_number(k % 9, 0)).otherwise("-"), F.lit("SSO FM 1707"), F.lit("2"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("seq"), cells.alias("cells"))
    found = workbooks.sites(rows).select(F.lit("site").alias("what"), "site", F.col("name").alias("told"), _k(F.col("lat")).alias("value"))
    return found.union(workbooks.metrics(rows, "SITE ID").select("metric", "SITE ID", "period", _k(F.col("value"))))
