"""Places in an order, without one task that sees all rows.

Rows are dealt out by ranges of their order and counted where they are; what comes before a part is
a sum over the parts, of which there are as many as partitions, and a row's place is that sum and
its place in the part. The parts are checkpointed, so that they stay what they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BEFORE = (Window.unboundedPreceding, -1)


def _parts(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    return rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()


def running(rows: DataFrame, groups: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Adds ``below``, the sum of ``n`` over the group's smaller values, and ``whole``, over the group.

    Each value of a group must be one row.
    """
    rows = _parts(rows, [*map(F.col, groups), F.col(value)])
    sums = rows.groupBy("_part", *groups).agg(F.sum(n).alias("_n"))
    by = Window.partitionBy(*groups)
    sums = sums.select("_part", *groups, F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_before"), F.sum("_n").over(by).alias("whole"))
    within = Window.partitionBy("_part", *groups).orderBy(value).rowsBetween(*_BEFORE)
    rows = rows.withColumn("_in", F.coalesce(F.sum(n).over(within), F.lit(0)))
    same = [rows[c].eqNullSafe(sums[c]) for c in ("_part", *groups)]
    return rows.join(sums, same).select(*[rows[c] for c in rows.columns if c not in ("_part", "_in")], (F.col("_before") + F.col("_in")).alias("below"), "whole")


def numbered(rows: DataFrame, order: Sequence[Column], out: str, groups: Sequence[str] = ()) -> DataFrame:
    """Adds each row's number from 1 in its group, by ``order``, which must tell all rows apart."""
    rows = _parts(rows, [*map(F.col, groups), *order])
    sums = rows.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select("_part", *groups, F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order)))
    same = [rows[c].eqNullSafe(sums[c]) for c in ("_part", *groups)]
    return rows.join(sums, same).select(*[rows[c] for c in rows.columns if c not in ("_part", "_in")], (F.col("_before") + F.col("_in")).cast("int").alias(out))


def percentiles(rows: DataFrame, key: str, values: dict[str, Column], scopes: dict[str, Column]) -> DataFrame:
    """Average positions from 0 to 1 of each value within each scope: ``key`` and a column ``value@scope`` for each.

    A scope is an expression whose equal results are one group (a literal: all rows). Null where the
    value is unknown, 0.5 where it is the only one. Keys must tell the rows apart.
    """
    each = [F.struct(F.lit(f"{v}@{s}").alias("what"), within.cast("string").alias("scope"), c.cast("double").alias("value")) for v, c in values.items() for s, within in scopes.items()]
    long = rows.select(key, F.explode(F.array(*each)).alias("e")).select(key, "e.*").where("value IS NOT NULL")
    counts = running(long.groupBy("what", "scope", "value").agg(F.count(F.lit(1)).alias("n")), ["what", "scope"], "value")
    place = F.when(F.col("whole") == 1, 0.5).otherwise((F.col("below") + (F.col("n") - 1) / 2.0) / (F.col("whole") - 1))
    counts = counts.select("what", F.col("scope").alias("_scope"), "value", place.alias("place"))
    placed = long.join(counts, ["what", "value"]).where(F.col("scope").eqNullSafe(F.col("_scope")))
    names = [f"{v}@{s}" for v in values for s in scopes]
    return placed.groupBy(key).agg(*[F.max(F.when(F.col("what") == x, F.col("place"))).alias(x) for x in names])
