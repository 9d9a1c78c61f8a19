"""Writing results (SNK-2 to 6, 8, 9, 11, 13, 15 to 17, 19, 20, WIN-6, WIN-10)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Attributes that a public copy must not have, as normalised names.
PRIVATE = ("UNIKDSE", "OUTLETID", "PHONE", "NIK", "OWNER")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], now: str, run: int) -> DataFrame:
    """``old`` with ``new`` rows in place of those with equal keys (SNK-2, WIN-10).

    ``first_seen`` stays, ``last_seen`` and ``run_id`` advance; of new rows with one key the last by all columns counts.
    For the metric table the key holds coalesce(period, '') (SNK-3).
    """
    plain = [c for c in new.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*plain)).alias("_row")).select(*keys, "_row.*")
    seen = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("first_seen").alias("_first"))
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    fresh = new.join(seen, match, "left").select(*new.columns, F.coalesce("_first", F.lit(now)).alias("first_seen"), F.lit(now).alias("last_seen"), F.lit(run).cast("long").alias("run_id"))
    return old.join(new, _same(old, new, keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def seeded(reference: DataFrame, told: DataFrame, key: str, value: str) -> DataFrame:
    """The reference with missing keys added and differing values corrected (SNK-20)."""
    both = reference.select(key, F.col(value).alias("_old")).join(told.select(key, F.col(value).alias("_new")), key, "full")
    return both.select(key, F.coalesce("_new", "_old").alias(value), F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old")), "corrected").otherwise("kept").alias("change"))


def suffixed(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keys made unique: the second row of a key gets ``#2`` and so on (WIN-6)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.concat_ws("#", F.col(key).cast("string"), "_n")).otherwise(F.col(key).cast("string"))).drop("_n")


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write rows in place of the partitions that they fall in, and no others (SNK-4, SNK-15, SNK-19)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def run_audit(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with their end, if they have one (SNK-5)."""
    return started.join(finished, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("running")))


def geojson_features(rows: DataFrame, geometry: Column, properties: Sequence[str]) -> DataFrame:
    """A feature as text for each row (SNK-8); ``write_geojson`` joins them to a collection."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def polygon_geometry(rings: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, as many files as partitions (SNK-8); every line is a document of its own."""
    features.write.mode("overwrite").text(path)


def write_collection(features: DataFrame, path: str, order: Sequence[Column]) -> None:
    """A feature collection in parts that many tasks write: put together in the order of their names, they are one document (SNK-8).

    Features are dealt out by ranges of ``order``, a line each. The first one has the head before it, all others a comma, and
    the last one the tail behind it; which ones these are, two numbers, is all that passes the driver. Without features
    the only part is an empty collection.
    """
    head, tail = '{"type":"FeatureCollection","features":[', "]}"
    rows = features.repartitionByRange(*order).sortWithinPartitions(*order, "value").select("value").checkpoint().withColumn("n", F.monotonically_increasing_id())
    ends = rows.agg(F.min("n").alias("first"), F.max("n").alias("last")).first()
    if ends.first is None:
        features.sparkSession.createDataFrame([(head + tail,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    line = F.concat(F.when(F.col("n") == ends.first, head).otherwise(","), "value", F.when(F.col("n") == ends.last, tail).otherwise(""))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def kml_placemarks(rows: DataFrame, name: str, lon: str, lat: str, folder: str, attributes: Sequence[str]) -> DataFrame:
    """A placemark as text for each row, by folder (SNK-9)."""
    safe = lambda c: reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.coalesce(F.col(c).cast("string"), F.lit("")))
    data = F.concat(*[F.concat(F.lit(f"<Data name={quoteattr(a)}><value>"), safe(a), F.lit("</value></Data>")) for a in attributes]) if attributes else F.lit("")
    mark = F.concat(F.lit("<Placemark><name>"), safe(name), F.lit("</name><ExtendedData>"), data, F.lit("</ExtendedData><Point><coordinates>"), F.col(lon).cast("string"), F.lit(","), F.col(lat).cast("string"), F.lit("</coordinates></Point></Placemark>"))
    return rows.select(F.col(folder).cast("string").alias("folder"), mark.alias("value"))


def write_kml(placemarks: DataFrame, path: str, title: str) -> None:
    """A KML file for each folder of placemarks (SNK-9, SNK-11): each folder's rows are streamed to its own directory."""
    head, tail = f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name>', "</Document></kml>"
    edges = placemarks.select("folder").distinct()
    rows = placemarks.select("folder", F.lit(1).alias("part"), "value").union(edges.select("folder", F.lit(0), F.lit(head))).union(edges.select("folder", F.lit(2), F.lit(tail)))
    rows.repartition("folder").sortWithinPartitions("folder", "part").select("folder", "value").write.mode("overwrite").partitionBy("folder").text(path)


def write_csv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header; a directory for each value of ``by`` (SNK-6, SNK-11, SNK-13)."""
    out = rows.write.mode("overwrite").option("header", True)
    (out.partitionBy(by) if by else out).csv(path)


def redacted(features: DataFrame, hidden_layers: DataFrame, private: Sequence[str] = PRIVATE) -> DataFrame:
    """Features without hidden layers and private attributes, whose names are compared normalised (SNK-16)."""
    name = lambda k: F.regexp_replace(F.upper(k), "[^A-Z0-9]", "")
    return features.join(hidden_layers.select("layer_key"), "layer_key", "left_anti").withColumn("attrs", F.map_filter("attrs", lambda k, v: ~name(k).isin(*private)))


def leaks(features: DataFrame, hidden_layers: DataFrame, private: Sequence[str] = PRIVATE) -> DataFrame:
    """How much of what ``redacted`` removes is in a copy: must be none (SNK-16)."""
    name = lambda k: F.regexp_replace(F.upper(k), "[^A-Z0-9]", "")
    bad = F.size(F.filter(F.map_keys("attrs"), lambda k: name(k).isin(*private))) > 0
    layers = features.join(hidden_layers.select("layer_key", F.lit(True).alias("hidden")), "layer_key", "left")
    return layers.agg(F.count_if("hidden").alias("in_hidden_layers"), F.count_if(bad).alias("with_private_attrs"))


def purged(features: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Features on the map, and the corrected counts of their layers (SNK-17)."""
    kept = features.where(inside)
    return kept, features.groupBy("layer_key").agg(F.count_if(inside).alias("feature_count"))


def _spread(n: Column) -> Column:
    """A number of 16 bits with a zero between any two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def curve(lon: Column, lat: Column) -> Column:
    """A place's number along a Z-shaped curve over the earth, 65,536 steps each way; null without a position."""
    step = lambda c, low, width: F.least(F.greatest(F.floor((c - low) / width * 65536), F.lit(0)), F.lit(65535)).cast("long")
    return F.when(lon.isNotNull() & lat.isNotNull(), _spread(step(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(step(lat, -90.0, 180.0)), 1)))


def write_places(rows: DataFrame, path: str, lon: Column, lat: Column, group_bytes: int = 16 << 20) -> None:
    """Rows laid down along a curve (SRC-1, SRC-3), so that the ranges of positions that Parquet keeps for each of its row groups
    are small, and a reader with a box skips most of them. Places are dealt out by ranges of the curve."""
    placed = rows.withColumn("_curve", curve(lon, lat))
    placed.repartitionByRange("_curve").sortWithinPartitions("_curve").drop("_curve").write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
