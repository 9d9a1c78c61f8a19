"""Files in and out, upserts and streams."""

import json
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrafold.sources import files, sinks
from terrafold.streaming import events

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>North</name>
<Placemark><name>A</name><ExtendedData><SchemaData><SimpleData name="DESA">Depok</SimpleData><SimpleData name="KEC">#N/A</SimpleData></SchemaData></ExtendedData>
<MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,2,0 3,4,0</coordinates></LinearRing></outerBoundaryIs></Polygon>
<Polygon><outerBoundaryIs><LinearRing><coordinates>5,6 7,6 7,8</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>
</Folder><Placemark><name>B</name><ExtendedData><Data name="k"><value> v </value></Data></ExtendedData></Placemark>
<Placemark><name>C</name><description><![CDATA[<table><tr><th colspan="2">Shop</th></tr><tr><td>KEC</td><td><b>Beji &amp; Limo</b></td></tr><tr><td>x</td><td>-</td></tr></table>]]></description><Point><coordinates>106.8,-6.2,0</coordinates></Point></Placemark>
<Placemark><name>D</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></Document></kml>"""


def test_separators():
    assert [files.separator(x) for x in ("a,b,c", "a;b", "a\tb", "a|b", '"a,b";c;d', "a", "")] == [",", ";", "\t", "|", ";", ",", ","]


def test_table_with_synonyms(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Outlet Name (x);Latitude;LONG;Other\n"A; B";-6,2;106,8;1\nC;106,8;-6,2;2\nD;;106,8;3\nE;95;120;4\n')
    rows = files.read_table(spark, str(tmp_path / "t.csv"), {"name": ["outletname"], "lat": ["lat", "latitude"], "lon": ["lon", "long"]})
    assert rows.columns == ["name", "lat", "lon", "Other"]
    got = {r.name: (r.lat, r.lon, r.reject) for r in files.with_positions(rows).collect()}
    assert got == {"A; B": (-6.2, 106.8, None), "C": (-6.2, 106.8, None), "D": (None, 106.8, "no_coords"), "E": (95.0, 120.0, "off_map")}


@pytest.mark.parametrize("packed", [False, True])
def test_kml(spark, tmp_path, packed):
    path = tmp_path / ("a.kmz" if packed else "a.kml")
    if packed:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("doc.kml", KML)
    else:
        path.write_text(KML)
    spark.dataSource.register(files.KmlSource)
    a, b, c, d = sorted(spark.read.format("kml").option("paths", str(path)).load().collect(), key=lambda r: r.name)
    assert (a.name, a.folder, a.attrs, len(a.polys)) == ("A", "North", {"DESA": "Depok"}, 2)
    assert [list(p) for p in a.polys[0][0]] == [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0]]
    assert (b.name, b.folder, b.attrs, b.polys) == ("B", "", {"k": "v"}, [])
    assert (c.attrs, [list(p) for p in c.points], c.polys) == ({"KEC": "Beji & Limo"}, [[106.8, -6.2]], [])
    assert [[list(p) for p in line] for line in d.lines] == [[[1.0, 2.0], [3.0, 4.0]]]


def test_workbook(spark, tmp_path):
    row = lambda n, *cells: f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cells) + "</row>"
    sheet = lambda *rows: f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(rows)}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet(row(1, ("A", "nothing"))))
        z.writestr("xl/worksheets/sheet2.xml", sheet(row(1, ("A", "Title")), row(2, ("A", "SITE"), ("B", "LAT"), ("C", "LON")), row(3, ("A", "s1"), ("B", "-6.2")), row(4)))
    spark.dataSource.register(files.SheetSource)
    rows = spark.read.format("sheets").option("paths", str(tmp_path / "b.xlsx")).option("columns", "SITE,LAT").load().collect()
    assert [r.cells for r in rows] == [{"SITE": "s1", "LAT": "-6.2"}]


def test_geojson_out_and_in(spark, tmp_path):
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A", "k": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[1.0, 2.0], [3.0, 2.0], [3.0, 4.0]]]}}, {"type": "Feature", "properties": {"NAME": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[1.0, 2.0], [3.0, 2.0], [3.0, 4.0]]]]}}]}
    (tmp_path / "a.json").write_text(json.dumps(collection))
    rows = files.read_geojson(spark, str(tmp_path / "a.json")).collect()
    assert [(r.name, [list(p) for p in r.polys[0][0]]) for r in rows] == [(n, [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0]]) for n in "AB"]
    points = spark.createDataFrame([(1, 106.8, -6.2)], "id long, lon double, lat double")
    feature = json.loads(sinks.geojson_features(points, sinks.point_geometry(F.col("lon"), F.col("lat")), ["id"]).first()[0])
    assert feature == {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [106.8, -6.2]}}


def test_map_elements(spark):
    rows = [("node", 1, -6.2, 106.8, None, {"railway": "station", "name": "M"}), ("way", 2, None, None, (-6.3, 106.9), {"amenity": "bank"}), ("relation", 3, None, None, None, {"shop": "mall"})]
    frame = spark.createDataFrame(rows, "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = sorted((r.place_id, r.lat, r.lon, r.category) for r in files.map_elements(frame).collect())
    assert got == [("node/1", -6.2, 106.8, "railway=station"), ("way/2", -6.3, 106.9, "amenity=bank")]


def test_tiles_cover_the_box(spark):
    box = spark.createDataFrame([("b", -6.65, 106.60, -5.85, 107.70)], "box string, south double, west double, north double, east double")
    two, five = (files.tiles(box, km).collect() for km in (2.0, 5.0))
    assert len(two) > 100 and len(five) < len(two) and two[0].metres == pytest.approx(2000 * 2**0.5 / 2)


def test_upsert_keeps_first_seen(spark):
    columns = "id string, name string"
    old = spark.createDataFrame([("1", "A", "t0", "t0", 1), ("2", "B", "t0", "t0", 1), (None, "N", "t0", "t0", 1)], columns + ", first_seen string, last_seen string, run_id long")
    new = spark.createDataFrame([("1", "A2"), ("3", "C"), (None, "N2"), ("3", "B")], columns)
    got = sorted((tuple(r) for r in sinks.upserted(old, new, ["id"], "t1", 2).collect()), key=str)
    assert got == sorted([("1", "A2", "t0", "t1", 2), ("2", "B", "t0", "t0", 1), ("3", "C", "t1", "t1", 2), (None, "N2", "t0", "t1", 2)], key=str)


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "v long, layer string")
    sinks.replace_partitions(frame([(1, "a"), (2, "b")]), path, "layer")
    sinks.replace_partitions(frame([(3, "b")]), path, "layer")
    assert sorted((r.v, r.layer) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_kml_file_of_each_folder(spark, tmp_path):
    rows = spark.createDataFrame([("A & B", 106.8, -6.2, "x"), ("C", 106.9, -6.3, "y")], "name string, lon double, lat double, folder string")
    sinks.write_kml(sinks.kml_placemarks(rows, "name", "lon", "lat", "folder", ["name"]), str(tmp_path / "k"), "T")
    spark.dataSource.register(files.KmlSource)
    paths = ",".join(map(str, (tmp_path / "k").glob("folder=*/part*")))
    assert sorted((r.name, r.attrs["name"]) for r in spark.read.format("kml").option("paths", paths).load().collect()) == [("A & B", "A & B"), ("C", "C")]


def test_redaction_leaves_no_leaks(spark):
    rows = spark.createDataFrame([("open", {"Unik_DSE": "1", "k": "v"}), ("hidden", {"k": "v"})], "layer_key string, attrs map<string,string>")
    hidden = spark.createDataFrame([("hidden",)], "layer_key string")
    assert [r.attrs for r in sinks.redacted(rows, hidden).collect()] == [{"k": "v"}]
    assert tuple(sinks.leaks(rows, hidden).first()) == (1, 1) and tuple(sinks.leaks(sinks.redacted(rows, hidden), hidden).first()) == (0, 0)


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(1704067200 + id * 600) AS ts, IF(id % 2 = 0, 'a', 'b') AS event_type, CAST(id AS DOUBLE) AS value FROM range(60)")
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    query = events.windowed_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 60
    run = lambda: events.upsert_stream(stream(), table, ["event_id"], str(tmp_path / "cp")).awaitTermination()
    run()
    rows.where("event_id >= 50").withColumn("value", F.lit(-1.0)).coalesce(1).write.mode("append").parquet(source)
    run()
    last = spark.read.parquet(f"{table}/v1")
    assert last.count() == 60 and last.where("value = -1").count() == 10
    assert {(r.first_seen, r.last_seen) for r in last.where("event_id >= 50").collect()} == {("batch-0", "batch-1")}


def test_a_collection_in_parts_is_one_document_that_many_tasks_read(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('say "x", {"type":"Feature",} '), "id").alias("name"), (F.col("id") * 0.1).alias("lon"))
    square = F.array(F.array(*[F.array(F.col("lon") + a, F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))]))
    features = sinks.geojson_features(rows, sinks.polygon_geometry(square), ["id", "name"])
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "8k"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        _collection(spark, tmp_path, features)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sinks.write_collection(features.limit(0), str(tmp_path / "none"), [F.col("value")])
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == {"type": "FeatureCollection", "features": []}
    assert files.read_large_geojson(spark, str(tmp_path / "none")).count() == 0


def _collection(spark, tmp_path, features):
    sinks.write_collection(features, str(tmp_path / "parts"), [F.col("value")])
    parts = sorted((tmp_path / "parts").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    told = json.loads(whole)
    assert len(parts) > 1 and len(told["features"]) == 500 and told["type"] == "FeatureCollection"
    # one file, in one line
    (tmp_path / "one.json").write_text(json.dumps(told, separators=(",", ":")))
    for path in ("parts", "one.json"):
        found = files.read_large_geojson(spark, str(tmp_path / path))
        assert found.rdd.getNumPartitions() > 4
        assert sorted((r.name, r.attrs["id"], r.polys) for r in found.collect()) == sorted((f["properties"]["name"], f["properties"]["id"], [f["geometry"]["coordinates"]]) for f in told["features"])


def _groups_in(path, box):
    """Row groups whose positions can lie in a box, and all."""
    found = total = 0
    for file in path.glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            total += 1
            found += stats["lon"].max >= box[1] and stats["lon"].min <= box[3] and stats["lat"].max >= box[0] and stats["lat"].min <= box[2]
    return found, total


def test_a_box_reads_few_row_groups_of_places_along_a_curve(spark, tmp_path):
    rows = spark.range(40_000).select("id", (F.rand(1) * 10 + 100).alias("lon"), (F.rand(2) * 10 - 8).alias("lat"), F.repeat(F.lit("x"), 50).alias("name"))
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows.repartition(64).write.parquet(str(tmp_path / "plain"))
        sinks.write_places(rows, str(tmp_path / "curve"), F.col("lon"), F.col("lat"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shares = []
    for side in (8.0, 2.0, 0.5):
        box = (-6.0, 102.0, -6.0 + side / 2, 102.0 + side / 2)
        assert _groups_in(tmp_path / "plain", box)[0] == _groups_in(tmp_path / "plain", box)[1]
        found, total = _groups_in(tmp_path / "curve", box)
        shares.append(found / total)
        inside = F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
        assert spark.read.parquet(str(tmp_path / "curve")).where(inside).count() == rows.where(inside).count() > 0
    assert shares[0] > shares[1] >= shares[2] and shares[1] < 0.15 and shares[2] < 0.08
    assert sorted(r[0] for r in spark.createDataFrame([(None, 1.0), (200.0, 95.0), (-180.0, -90.0)], "lon double, lat double").select(sinks.curve(F.col("lon"), F.col("lat"))).collect() if r[0] is not None) == [0, 2**32 - 1]


def test_loose_files_with_a_late_header_or_none(spark, tmp_path):
    synonyms = {"name": ["outletname", "name"], "lat": ["lat", "latitude"], "lon": ["lon", "long"]}
    read = lambda text: (lambda p: p.write_text(text) and files.read_loose(spark, str(p), synonyms))(tmp_path / f"{abs(hash(text))}.csv")
    late = read('Report of May\n\nNo;Outlet Name;Latitude;LONG;Note;Name\n1;"A; B";-6,2;106,8;x;y\n\n2;C;-6,3;106,9;;\n')
    assert late.columns == ["No", "name", "lat", "lon", "Note", "Name"]
    assert [tuple(r)[:5] for r in late.collect()] == [("1", "A; B", "-6,2", "106,8", "x"), ("2", "C", "-6,3", "106,9", None)]
    bare = read("7,North,106.8,-6.2\n8,South,106.9,-6.3\n9,East,,-6.1\n")
    assert bare.columns == ["c0", "name", "lon", "lat"] or bare.columns == ["lat", "name", "lon", "c3"]
    assert bare.select("name").collect()[2][0] == "East"
    assert read("just words\nmore words\n").columns == ["name"]
    assert read(" \n").count() == 0
