"""Queries over scalar derivations and filters (§2.3 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import classify, geo, text
from terrafold.operators import facets

from .fixtures import frame, with_
from .registry import query


def _k(c, scale=1000):
    """Doubles as whole numbers, so that both engines hold the same."""
    return F.floor(c * float(scale) + 0.5).cast("long")


def _case(column, *names):
    return f"CASE {column} % {len(names)} " + " ".join(f"WHEN {k} THEN {'NULL' if x is None else repr(x)}" for k, x in enumerate(names)) + " END"


@query("prj1_prj3_brand", with_("parts") + r"""
SELECT point_id, CASE WHEN point_id % 7 = 0 THEN 'BSI (Bank Syariah Indonesia)' WHEN point_id % 7 = 1 THEN 'Agen BRILink' WHEN point_id % 7 = 2 THEN 'Alfamart'
 WHEN point_id % 7 = 3 THEN 'BCA' WHEN point_id % 7 = 4 THEN 'BRI' WHEN point_id % 7 = 5 THEN 'Alfamidi' END AS brand FROM parts""")
def _(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["Bank Syariah Indonesia KCP ", "Agen BRILink Pak ", "Alfamart ", "Bank BCA KCP ", "Bank BRI Unit ", "Alfa Midi ", "Warung Bu "])), (F.col("point_id") % 7 + 1).cast("int"))
    return frame(spark, d, "parts").select("point_id", classify.brand(F.concat(label, F.col("name"))).alias("brand"))


@query("prj2_brand_by_field", with_("parts") + r"""
SELECT point_id, CASE WHEN point_id % 4 = 0 THEN 'BCA' WHEN point_id % 4 = 1 THEN 'Indomaret' WHEN point_id % 4 = 2 THEN 'BNI' END AS brand FROM parts""")
def _(spark, d):
    m = F.col("point_id") % 4
    rows = frame(spark, d, "parts").select("point_id", F.when(m == 0, "Q806626").alias("qid"), F.when(m == 1, "Indo Maret").alias("b"), F.when(m == 2, "bni").alias("o"), F.when(m == 2, "Alfamart").otherwise("kios").alias("n"))
    return rows.select("point_id", classify.brand_by_field(F.col("qid"), F.col("b"), F.col("o"), F.col("n")).alias("brand"))


@query("prj4_place_class", with_("parts") + r"""
SELECT point_id, CASE WHEN point_id % 3 = 0 THEN CASE WHEN size % 2 = 0 THEN 'bus' ELSE 'bank' END WHEN point_id % 3 = 1 THEN CASE WHEN size % 2 = 0 THEN 'rail' ELSE 'agent' END
 ELSE CASE WHEN size % 2 = 0 THEN 'retail' ELSE 'atm' END END AS class FROM parts""")
def _(spark, d):
    even = F.col("size") % 2 == 0
    source = F.element_at(F.array(F.lit("overture"), F.lit("google"), F.lit("osm")), (F.col("point_id") % 3 + 1).cast("int"))
    category = F.when(source == "overture", F.when(even, "transit_station").otherwise("banks")).when(source == "google", F.when(even, "transit_station").otherwise("convenience_store")).otherwise(F.when(even, "shop=convenience").otherwise("amenity=bank"))
    target = F.when(source == "google", F.when(~even, "brilink")).when(source == "osm", F.when(~even, "atms"))
    return frame(spark, d, "parts").select("point_id", classify.place_class(source, category, target).alias("class"))


@query("prj5_dot_class", with_("parts") + r"""
SELECT point_id, CASE WHEN category = 'STANDARD ANODIZED TIN' THEN 'exact' WHEN contains(category, 'STEEL') THEN 'steel' WHEN contains(category, 'PROMO') THEN 'promo' ELSE 'poi_other' END AS dot FROM parts""")
def _(spark, d):
    return frame(spark, d, "parts").select("point_id", classify.dot_class(F.col("category"), {"STANDARD ANODIZED TIN": "exact"}, [("STEEL", "steel"), ("PROMO", "promo")]).alias("dot"))


@query("prj6_swap_repair", with_("outlets") + r"""
SELECT point_id, CAST(floor(lat * 1000000 + 0.5) AS BIGINT) AS lat_e6, CAST(floor(lon * 1000000 + 0.5) AS BIGINT) AS lon_e6 FROM outlets""")
def _(spark, d):
    swap = F.col("point_id") % 2 == 0
    rows = frame(spark, d, "outlets").select("point_id", F.when(swap, F.col("lon")).otherwise(F.col("lat")).alias("a"), F.when(swap, F.col("lat")).otherwise(F.col("lon")).alias("b"))
    lat, lon = geo.repaired(F.col("a"), F.col("b"))
    return rows.select("point_id", _k(lat, 1_000_000).alias("lat_e6"), _k(lon, 1_000_000).alias("lon_e6"))


_POINTS = ("Gerai Indosat Ooredoo Hutchison", "GraPARI", "XL Center", "3 Store", "DRYNA CELL", "Toko", "Konter Telkomsel", "Excellent Cellular", "59 Cel", "3ID Bekasi", "Hutchison 3 Kios")
_PLACES = ("Peta", "IPP Bekasi", None, "Telkomsel", "pulsa murah", "counterpart", "The Counter")


@query("prj7_operator", with_("outlets") + f""", f AS (SELECT point_id, {_case('point_id', *_POINTS)} AS name, {_case('point_id', *_PLACES)} AS folder FROM outlets), t AS (SELECT *, lower(concat_ws(' ', folder, name)) AS told FROM f),
 o AS (SELECT *, CASE WHEN regexp_matches(told, 'indosat|\\bim3\\b|ooredoo|\\bioh\\b') THEN 'IM3' WHEN regexp_matches(told, 'telkomsel|\\btsel\\b|grapari|gerai\\s*halo') THEN 'TSEL' WHEN regexp_matches(told, '\\bxl\\b|axiata|\\baxis\\b') THEN 'XL' WHEN regexp_matches(told, 'smartfren|\\bsf\\b|smart\\s*telecom') THEN 'SF' WHEN regexp_matches(told, '\\b3id\\b|\\btri\\b|\\b3\\s?store\\b|hutchison|\\b3\\s?kios\\b') THEN '3ID' ELSE 'OTHER' END AS op FROM t),
 c AS (SELECT *, coalesce(regexp_matches(lower(folder), '\\bipp\\b|konter|\\bcounter\\b|pulsa'), false) OR op = 'OTHER' AND regexp_matches(lower(name), '\\bcell\\b|\\bcel\\b|\\bponsel\\b|\\bselular\\b|\\bseluler\\b|konter') AS counter FROM o)
SELECT point_id, CASE WHEN counter THEN 'IPP' ELSE op END AS operator, CASE WHEN counter THEN 'outlet' WHEN op = 'OTHER' THEN 'unknown' ELSE 'operator' END AS class FROM c""")
def _(spark, d):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("point_id") % len(names) + 1).cast("int"))
    none = F.lit(None).cast("string")
    operator, group = classify.service_point(none, pick(_PLACES), pick(_POINTS), none)
    return frame(spark, d, "outlets").select("point_id", operator.alias("operator"), group.alias("class"))


@query("prj8_prj24_derived", with_("boxes") + r"""
SELECT key, CAST(floor(CAST(population AS DOUBLE) / CAST(key + 1 AS DOUBLE) + 0.5) AS BIGINT) AS density, CASE WHEN key % 2 = 0 THEN 'R' || region || ' › ' || name ELSE name END AS hierarchy FROM boxes""")
def _(spark, d):
    rows = frame(spark, d, "boxes")
    top = F.when(F.col("key") % 2 == 0, F.concat(F.lit("R"), F.col("region").cast("string"))).otherwise(" ")
    return rows.select("key", classify.density(F.col("population").cast("double"), (F.col("key") + 1).cast("double")).alias("density"), classify.hierarchy(top, F.col("name")).alias("hierarchy"))


@query("prj9_prj10_headers", r"""WITH t AS (SELECT o_orderkey, lower(replace(o_orderpriority, '-', '_')) AS raw, CASE o_orderkey % 3 WHEN 0 THEN 'MTD' WHEN 1 THEN 'FM' ELSE 'YTD' END AS kind, month(CAST(o_orderdate AS DATE)) AS m, CAST(year(CAST(o_orderdate AS DATE)) % 100 AS INTEGER) AS y FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'vlr_subs_' || o_orderkey % 9 ELSE 'vlr_subs' END AS metric, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE kind || ' ' || CAST(1000 + o_orderkey % 9000 AS VARCHAR) END AS period, CASE o_orderkey % 5 WHEN 4 THEN '' ELSE ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][m] || chr(39) || lpad(CAST(y AS VARCHAR), 2, '0') END AS title FROM t""")
def _(spark, d):
    rows, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("MTD"), F.lit("FM"), F.lit("YTD")), (k % 3 + 1).cast("int"))
    metric, period = text.metric_and_period(F.when(k % 4 == 3, F.concat(F.lit("Vlr  Subs "), k % 9)).otherwise(F.concat(F.lit("Vlr  Subs "), kind, F.lit(" "), (k % 9000 + 1000).cast("string"))))
    date = F.col("o_orderdate").cast("date")
    named = F.when(k % 5 == 4, "Outlets.xlsx").when(k % 5 == 3, F.concat(F.lit("Jabo "), F.date_format(date, "MMM yy"))).otherwise(F.concat(F.lit("Outlets_"), F.upper(F.date_format(date, "MMMM")), F.lit(" 20"), F.date_format(date, "yy"), F.lit(".xlsx")))
    return rows.select("o_orderkey", metric.alias("metric"), period.alias("period"), text.month_period(named).alias("title"))


@query("prj11_prj13_keys", r"""
SELECT p_partkey, regexp_replace(upper(p_name || p_brand), '[^A-Z0-9]', '', 'g') AS norm_key, regexp_replace(upper(p_type), '[^\p{L}\p{N}]', '', 'g') AS alnum_key,
 regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS header FROM part""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    return rows.select("p_partkey", text.norm_key(F.col("p_name"), F.col("p_brand")).alias("norm_key"), text.alnum_key(F.col("p_type")).alias("alnum_key"), text.header_key(F.concat(F.col("p_brand"), F.lit(" (unit)"))).alias("header"))


@query("prj14_numbers", r"""
SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 10 + 5 AS thousands_x10, -(CAST(floor(o_totalprice) AS BIGINT) % 90) * 100 - 25 AS comma_x100, NULL::BIGINT AS nothing FROM orders""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet")
    whole = F.floor("o_totalprice").cast("long")
    grouped = text.number_with_thousands(F.concat(F.format_number(whole, 0), F.lit(".5")))
    comma = text.number_with_decimal_comma(F.concat(F.lit("-"), (whole % 90).cast("string"), F.lit(",25")))
    return rows.select("o_orderkey", _k(grouped, 10).alias("thousands_x10"), (-_k(-comma, 100)).alias("comma_x100"), text.number_with_thousands(F.lit("#N/A")).cast("long").alias("nothing"))


@query("prj15_place_key", with_("outlets") + r"""
SELECT point_id, 'sp:' || substr(sha1(lower(trim(name)) || '|' || printf('%.6f', CAST(point_id AS DOUBLE)) || '|' || printf('%.6f', CAST(nation AS DOUBLE))), 1, 20) AS key FROM outlets""")
def _(spark, d):
    rows = frame(spark, d, "outlets")
    return rows.select("point_id", text.place_key(F.col("name"), F.col("point_id"), F.col("nation")).alias("key"))


@query("prj16_prj17_name_similarity", r"""
WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM part)
SELECT p_partkey, array_to_string(a, ' ') AS words, CASE WHEN len(a) > 0 AND len(b) > 0 THEN CAST(floor(CAST(len(list_intersect(a, b)) AS DOUBLE) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) * 1000 + 0.5) AS BIGINT) END AS similarity FROM t""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.name_tokens(F.col("p_name")).alias("a"), text.name_tokens(F.col("p_type")).alias("b"))
    return rows.select("p_partkey", F.array_join("a", " ").alias("words"), _k(text.jaccard(F.col("a"), F.col("b"))).alias("similarity"))


@query("prj18_prj19_prj31_distances", with_("outlets") + r"""
SELECT point_id, CAST(floor(CAST(12742017.6 AS DOUBLE) * asin(sqrt(pow(sin(radians(-6.2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-6.2)) * pow(sin(radians(106.8 - lon) / 2), 2))) + 0.5) AS BIGINT) AS metres,
 CAST(floor(lat * 111320.0 + 0.5) AS BIGINT) AS north FROM outlets""")
def _(spark, d):
    rows = frame(spark, d, "outlets")
    _, north = geo.projected(F.col("lat"), F.col("lon"), F.lit(-6.25))
    return rows.select("point_id", _k(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(-6.2), F.lit(106.8)), 1).alias("metres"), _k(north, 1).alias("north"))


@query("prj31_compass", with_("outlets") + r"""
SELECT point_id, CASE CAST(floor(b / 45.0 + 0.5) AS BIGINT) % 8 WHEN 0 THEN 'N' WHEN 1 THEN 'NE' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' ELSE 'NW' END AS point
FROM (SELECT point_id, CAST((degrees(atan2(sin(radians(106.8 - lon)) * cos(radians(-6.2)), cos(radians(lat)) * sin(radians(-6.2)) - sin(radians(lat)) * cos(radians(-6.2)) * cos(radians(106.8 - lon)))) + 360.0) AS DOUBLE) % CAST(360 AS DOUBLE) AS b FROM outlets)""")
def _(spark, d):
    return frame(spark, d, "outlets").select("point_id", geo.compass(geo.bearing(F.col("lat"), F.col("lon"), F.lit(-6.2), F.lit(106.8))).alias("point"))


@query("prj20_distance_ramp", with_("outlets") + r"""
SELECT point_id, CASE WHEN point_id % 10 <> 0 THEN CAST(floor(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (CAST(point_id % 20 AS DOUBLE) - 2) / 13)) * 1000 + 0.5) AS BIGINT) END AS ramp FROM outlets""")
def _(spark, d):
    km = F.when(F.col("point_id") % 10 != 0, (F.col("point_id") % 20).cast("double"))
    return frame(spark, d, "outlets").select("point_id", _k(geo.distance_ramp(km, 2.0, 15.0)).alias("ramp"))


@query("prj21_prj23_strata_bands", with_("boxes") + r"""
SELECT key, CASE WHEN key % 2 = 0 THEN 'urban' ELSE 'rural' END AS stratum, CASE WHEN population >= 30000 THEN 'urban' ELSE 'rural' END AS by_density,
 CASE WHEN population < 25000 THEN 0 WHEN population < 35000 THEN 1 ELSE 2 END AS band FROM boxes""")
def _(spark, d):
    rows = frame(spark, d, "boxes")
    city = F.when(F.col("key") % 2 == 0, " kota Depok ").otherwise("KARAWANG")
    return rows.select("key", classify.stratum(city).alias("stratum"), classify.stratum_by_density(F.col("population"), 30000).alias("by_density"), classify.band(F.col("population"), [25000, 35000]).alias("band"))


@query("prj22_prj32_colours", with_("boxes") + r"""
SELECT key, CAST(floor((CAST(key AS DOUBLE) * CAST(137.508 AS DOUBLE)) % CAST(360 AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS hue, CAST(floor(least(CAST(0.48 AS DOUBLE), CAST(0.06 AS DOUBLE) + CAST(population AS DOUBLE) / CAST(max(population) OVER () AS DOUBLE) * CAST(0.42 AS DOUBLE)) * 1000 + 0.5) AS BIGINT) AS opacity FROM boxes""")
def _(spark, d):
    rows = frame(spark, d, "boxes")
    top = rows.agg(F.max("population")).first()[0] or 1
    opacity = F.least(F.lit(0.48), F.lit(0.06) + F.col("population") / float(top) * 0.42)
    return rows.select("key", _k(classify.golden_hue(F.col("key").cast("double"))).alias("hue"), _k(opacity).alias("opacity"))


@query("prj26_prj29_attributes", r"""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 'DEPOK' ELSE upper(event_type) END AS place FROM events""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    attrs = F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, v: F.upper(k))
    place = text.first_not_blank(F.when(F.col("event_id") % 2 == 0, " Depok ").otherwise("#N/A"), F.col("event_type"))
    return rows.select("event_id", attrs["K"].cast("long").alias("k"), place.alias("place"))


@query("prj27_prj30_address", with_("parts") + r"""
SELECT point_id, CASE WHEN size % 3 = 0 THEN 'Jl. ' || name WHEN size % 3 = 1 THEN brand || ', ' || category END AS address FROM parts""")
def _(spark, d):
    m = F.col("size") % 3
    full = F.when(m == 0, F.concat(F.lit("Jl. "), F.col("name"))).otherwise(" ")
    return frame(spark, d, "parts").select("point_id", text.composed_address(full, F.when(m == 1, F.col("brand")), F.when(m == 1, F.col("category")).otherwise("")).alias("address"))


@query("flt3_flt4_targets", with_("parts") + r"""
SELECT point_id FROM parts WHERE point_id % 5 = 0 AND size >= 10 OR point_id % 5 = 1 AND size >= 10""")
def _(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["Stasiun Manggarai", "kereta", "Stasiun Pengisian Bahan Bakar Umum", "LRT City Sentul", "Apotek K24"])), (F.col("point_id") % 5 + 1).cast("int"))
    test = classify.wanted(label, F.when(F.col("point_id") % 5 == 1, "train_station"), F.col("size") / 50.0, F.lit(None).cast("string"), F.lit(None).cast("string"), ["train_station", "metro_station"], r"\bstasiun\b|\bmrt\b|\blrt\b", r"stasiun pengisian|lrt city|apartment", 0.2)
    return frame(spark, d, "parts").where(test).select("point_id")


@query("flt5_flt6_on_map", with_("outlets") + r"""
SELECT count(*) AS n, count(*) FILTER (WHERE point_id % 4 < 2) AS off_map, count(*) FILTER (WHERE point_id % 4 > 1) AS on_map FROM outlets""")
def _(spark, d):
    rows = frame(spark, d, "outlets").withColumn("lat", F.when(F.col("point_id") % 4 == 0, None).when(F.col("point_id") % 4 == 1, -F.col("lat") * 2).otherwise(F.col("lat")))
    test = geo.on_map(F.col("lat"), F.col("lon"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~test).alias("off_map"), F.count_if(test).alias("on_map"))


@query("flt15_funnel", with_("parts") + r"""
SELECT count(*) FILTER (WHERE contains(category, 'STEEL')) AS by_category, count(*) FILTER (WHERE contains(name, '1')) AS by_name, count(*) FILTER (WHERE contains(category, 'STEEL') OR contains(name, '1')) AS either,
 count(*) FILTER (WHERE (contains(category, 'STEEL') OR contains(name, '1')) AND size > 20) AS sure FROM parts""")
def _(spark, d):
    c, n = F.contains("category", F.lit("STEEL")), F.contains("name", F.lit("1"))
    return facets.buckets(frame(spark, d, "parts"), {"by_category": c, "by_name": n, "either": c | n, "sure": (c | n) & (F.col("size") > 20)})


@query("flt1_flt9_table", with_("parts") + r"""
SELECT point_id, name, brand FROM parts WHERE lower(name) LIKE '%ring%' AND brand = 'Brand#2' ORDER BY coalesce(brand, name) NULLS FIRST, point_id LIMIT 5000""")
def _(spark, d):
    rows = frame(spark, d, "parts").where(F.lower("name").like("%ring%") & (F.col("brand") == "Brand#2"))
    return rows.orderBy(F.coalesce("brand", "name").asc_nulls_first(), "point_id").select("point_id", "name", "brand").limit(5000)


@query("flt14_prefix_search", r"""
SELECT layer, name FROM (SELECT layer, name, row_number() OVER (ORDER BY prio, name) AS r FROM (SELECT 'nation' AS layer, 1 AS prio, n_name AS name FROM nation UNION ALL SELECT 'region', 2, r_name FROM region) WHERE starts_with(upper(name), 'A')) WHERE r <= 10""")
def _(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.lit("nation").alias("layer"), F.lit(1).alias("prio"), F.col("n_name").alias("name"))
    regions = spark.read.parquet(f"{d}/region.parquet").select(F.lit("region"), F.lit(2), "r_name")
    return nations.union(regions).where(F.startswith(F.upper("name"), F.lit("A"))).orderBy("prio", "name").limit(10).select("layer", "name")
