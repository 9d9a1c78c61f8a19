"""Workbooks told apart by their headers, and the tables that come out of them (SRC-21, SRC-22, SRC-24).

Rows have ``cells``, a map of cells by header, as ``SheetSource`` reads them, and ``seq``, their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.text import metric_and_period, norm_key, not_blank, number_with_decimal_comma, number_with_thousands

#: What headers each kind of sheet has (one of each group), the first kind that fits.
SHEETS = (
    ("site", (("SITE ID", "SITE_ID"), ("LAT", "LATITUDE", "SITE LAT"))),
    ("village", (("KEL_DES",), ("KEC",), ("KAB_KOT",))),
    ("hierarchy", (("CIRCLE",), ("REGION",), ("AREA",), ("BRANCH",), ("MC",))),
    ("district", (("KECAMATAN",), ("MC",))),
    ("store", (("STORE NAME",), ("LONGITUDE", "LATITUDE"))),
    ("operator", (("OPERATOR",), ("LATITUDE", "LAT"))),
    ("agent", (("NIK AGENT",),)),
)


def sheet_kind(headers: Column) -> Column:
    """The kind of sheet that an array of headers tells (SRC-21); null for others."""
    up = F.transform(headers, lambda h: F.upper(F.trim(h)))
    out = F.lit(None).cast("string")
    for kind, groups in reversed(SHEETS):
        test = F.lit(True)
        for some in groups:
            test = test & F.arrays_overlap(up, F.array(*map(F.lit, some)))
        out = F.when(test, kind).otherwise(out)
    return out


def _cell(*names: str) -> Column:
    """The first of the named cells that says something."""
    return F.coalesce(*[not_blank(F.col("cells")[n]) for n in names])


def villages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Villages of a profile, and how many rows were ``kept``, ``outside`` (no branch) or ``unnamed`` (SRC-22).

    Of rows with one village key the last counts. Population is a whole number; figures that can't be read are null.
    """
    named = rows.select("seq", _cell("KEL_DES").alias("village"), _cell("KEC").alias("district"), _cell("KAB_KOT").alias("city"), _cell("MCAGUS", "MC").alias("mc"), _cell("BRANCHAGUS", "BRANCH").alias("branch"), number_with_thousands(F.col("cells")["POPULASI_2"]).cast("long").alias("population"), number_with_thousands(F.col("cells")["LUAS_DESA"]).alias("area_m2"), _cell("GEO_TYPE").alias("geo"))
    state = F.when(F.col("village").isNull() | F.col("district").isNull(), "unnamed").when(F.col("branch").isNull(), "outside").otherwise("kept")
    named = named.withColumn("state", state)
    key = F.upper(F.concat_ws("|", "village", "district", F.coalesce("city", F.lit(""))))
    kept = named.where("state = 'kept'").drop("state").withColumn("key", key)
    last = kept.groupBy("key").agg(F.max_by(F.struct(*[c for c in kept.columns if c not in ("key", "seq")]), "seq").alias("one")).select("key", "one.*")
    joined = last.withColumn("join_key", norm_key(F.col("village"), F.col("district"), F.col("city")))
    return joined, named.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def metrics(rows: DataFrame, *key: str) -> DataFrame:
    """A row for each cell whose header names a metric and a period (SRC-22): the key's cells, ``metric``, ``period``, ``value``."""
    long = rows.select(*[_cell(k).alias(k) for k in key], F.explode("cells").alias("header", "cell"))
    metric, period = metric_and_period(F.col("header"))
    return long.select(*key, metric.alias("metric"), period.alias("period"), number_with_thousands(F.col("cell")).alias("value")).where("period <> '' AND value IS NOT NULL")


def sites(rows: DataFrame) -> DataFrame:
    """Sites of a site master with readable positions (SRC-24); of rows with one id the last counts."""
    told = rows.select("seq", _cell("SITE ID", "SITE_ID").alias("site"), _cell("SITE NAME", "SITE_NAME").alias("name"), number_with_decimal_comma(F.coalesce(*[F.col("cells")[c] for c in ("LAT", "LATITUDE", "SITE LAT")])).alias("lat"), number_with_decimal_comma(F.coalesce(*[F.col("cells")[c] for c in ("LON", "LONG", "LONGITUDE", "SITE LONG")])).alias("lon"))
    told = told.where("site IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    return told.groupBy("site").agg(F.max_by(F.struct("name", "lat", "lon"), "seq").alias("one")).select("site", "one.*")
