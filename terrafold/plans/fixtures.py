"""The driver's tables read as territories: the same expressions serve Spark and the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LON = "CAST(106.60 AS DOUBLE) + CAST(({k} * 7919) % 110000 AS DOUBLE) / CAST(100000 AS DOUBLE)"
_LAT = "CAST(-6.65 AS DOUBLE) + CAST(({k} * 104729) % 80000 AS DOUBLE) / CAST(100000 AS DOUBLE)"
_COL = "CAST(n_nationkey % 5 AS DOUBLE)"
_ROW = "CAST(floor(CAST(n_nationkey AS DOUBLE) / CAST(5 AS DOUBLE)) AS DOUBLE)"

#: name: table and its expressions.
FIXTURES: dict[str, tuple[str, list[str]]] = {
    "outlets": (
        "customer",
        [
            "c_custkey AS point_id",
            "c_name AS name",
            "CAST(c_custkey % 97 AS BIGINT) AS rep",
            "c_mktsegment AS brand",
            "c_nationkey AS nation",
            "CAST(c_custkey % 11 AS BIGINT) AS village",
            "CAST(floor(c_acctbal) AS BIGINT) AS value",
            "CAST(c_custkey % 7 + 1 AS BIGINT) AS weight",
            "CAST(c_custkey % 5 AS BIGINT) AS share",
            "CAST(c_custkey % 400 AS BIGINT) AS code",
            _LON.format(k="c_custkey") + " AS lon",
            _LAT.format(k="c_custkey") + " AS lat",
        ],
    ),
    "sites": ("supplier", ["s_suppkey AS point_id", "s_name AS name", "CASE WHEN s_suppkey % 3 = 0 THEN 'atm' WHEN s_suppkey % 3 = 1 THEN 'bank' ELSE 'minimarket' END AS kind", _LON.format(k="(s_suppkey * 31 + 17)") + " AS lon", _LAT.format(k="(s_suppkey * 57 + 5)") + " AS lat"]),
    "boxes": (
        "nation",
        [
            "n_nationkey AS key",
            "n_nationkey AS pos",
            "n_name AS name",
            "n_regionkey AS region",
            f"CAST(106.60 AS DOUBLE) + {_COL} * CAST(0.22 AS DOUBLE) AS x0",
            f"CAST(106.60 AS DOUBLE) + {_COL} * CAST(0.22 AS DOUBLE) + CAST(0.21 AS DOUBLE) AS x1",
            f"CAST(-6.65 AS DOUBLE) + {_ROW} * CAST(0.16 AS DOUBLE) AS y0",
            f"CAST(-6.65 AS DOUBLE) + {_ROW} * CAST(0.16 AS DOUBLE) + CAST(0.15 AS DOUBLE) AS y1",
            "n_nationkey % 3 = 0 AS holed",
            "CAST(20000 + n_nationkey * 1000 AS BIGINT) AS population",
        ],
    ),
    "metrics": ("orders", ["o_custkey AS entity", "o_orderstatus AS metric", "substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS period", "CAST(floor(o_totalprice) AS BIGINT) AS value"]),
    "parts": ("part", ["p_partkey AS point_id", "p_name AS name", "p_brand AS brand", "p_type AS category", "p_size AS size", "CAST(floor(p_retailprice) AS BIGINT) AS price"]),
    "lines": ("lineitem", ["l_partkey AS code", "l_suppkey AS rep", "l_orderkey AS order_id", "l_returnflag AS flag", "CAST(l_quantity AS BIGINT) AS quantity"]),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = FIXTURES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def sql(name: str) -> str:
    """The fixture as a common table expression."""
    table, columns = FIXTURES[name]
    return f"{name} AS (SELECT {', '.join(columns)} FROM {table})"


def with_(*names: str) -> str:
    return "WITH " + ", ".join(map(sql, names))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as rings; every third has a hole in its middle third."""
    point = lambda x, y: F.array(x, y)
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    w, h = (x1 - x0) / 3.0, (y1 - y0) / 3.0
    outer = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
    hole = F.array(point(x0 + w, y0 + h), point(x1 - w, y0 + h), point(x1 - w, y1 - h), point(x0 + w, y1 - h))
    rows = frame(spark, sf_dir, "boxes")
    return rows.select("key", "pos", "name", "region", "population", F.when(F.col("holed"), F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"), ((x0 + x1) / 2).alias("clon"), ((y0 + y1) / 2).alias("clat"), F.when(F.col("holed"), 8).otherwise(9).alias("area_km2"))


#: Whether a point lies in a box, by the half-open rule of the even-odd test, in SQL.
IN_BOX = """(o.lon < b.x1 AND o.lon >= b.x0 AND o.lat >= b.y0 AND o.lat < b.y1 AND NOT (b.holed
 AND o.lon >= b.x0 + (b.x1 - b.x0) / 3.0 AND o.lon < b.x1 - (b.x1 - b.x0) / 3.0
 AND o.lat >= b.y0 + (b.y1 - b.y0) / 3.0 AND o.lat < b.y1 - (b.y1 - b.y0) / 3.0))"""

#: Metres between (lat, lon) of o and p, in SQL.
METRES = """(CAST(12742017.6 AS DOUBLE) * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(p.lat - o.lat) / 2), 2)
 + cos(radians(o.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - o.lon) / 2), 2)))))"""
