"""Facets, buckets, completeness and funnels (AGG-1 to 3, 19, 20, 29 to 31, 34 to 37, FLT-1, 13, 15, 17, 18, SET-5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def facet(rows: DataFrame, column: str, most: int = 300) -> DataFrame:
    """Values that are not blank with their counts, most frequent first (AGG-1)."""
    told = rows.where(F.trim(F.col(column)) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return told.orderBy(F.col("n").desc(), "value").limit(most)


def buckets(rows: DataFrame, tests: Mapping[str, Column | None]) -> DataFrame:
    """Counts of all buckets in one pass; a bucket the source can't express is null, not 0 (AGG-2, FLT-2, FLT-15)."""
    return rows.agg(*[(F.lit(None).cast("long") if c is None else F.count_if(c)).alias(k) for k, c in tests.items()])


def completeness(rows: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Filled cells of each column and their share in tenths of a percent, over all or by a column (AGG-3)."""
    keys = [by] if by else []
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot([*keys, "n"], list(columns), "field", "filled")
    return long.withColumn("permille", F.when(F.col("n") > 0, F.floor(F.col("filled") * 1000.0 / F.col("n") + 0.5)).cast("long"))


def tally(rows: DataFrame, value: Column) -> DataFrame:
    """Counts by an attribute, blanks as ``(blank)`` (AGG-19, AGG-31)."""
    told = F.coalesce(F.when(F.trim(value) != "", value), F.lit("(blank)"))
    return rows.groupBy(told.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def field_model(rows: DataFrame, columns: Sequence[str], most: int = 60) -> DataFrame:
    """Each column's distinct values: how many, and the most frequent (AGG-20)."""
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "field", "value").where("value IS NOT NULL")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    sizes = counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_distinct"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).join(sizes, "field")


def grouping_fields(attributes: DataFrame) -> DataFrame:
    """Attributes (``row``, ``field``, ``value``) whose number of values suits a grouping (FLT-13)."""
    told = attributes.where(F.trim(F.col("value")) != "").groupBy("field").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("row").alias("n_rows"))
    return told.where((F.col("n_values") >= 2) & (F.col("n_values") <= F.greatest(F.lit(3), F.floor(F.col("n_rows") / 4))))


def classified(layers: DataFrame, signatures: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Layers (``fields``: array) with the first signature whose fields they all have (FLT-18, SET-5)."""
    out = F.lit(None).cast("string")
    for name, need in sorted(signatures, key=lambda s: len(s[1])):
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, need)), "fields")) == 0, name).otherwise(out)
    return layers.withColumn("kind", out)


def found(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The row whose key equals in any of the columns, case ignored (FLT-17)."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.upper(c) == key.upper(), F.lit(False))
    return rows.where(test).orderBy(*columns).limit(1)


def readiness(needs: DataFrame, loaded: DataFrame) -> DataFrame:
    """Pages (``page``, ``layer``, ``must``) with what they miss (AGG-36)."""
    rows = needs.join(loaded.select("layer", F.lit(True).alias("here")), "layer", "left")
    missing = F.collect_list(F.when(F.col("here").isNull() & F.col("must"), F.col("layer")))
    helps = F.collect_list(F.when(F.col("here").isNull() & ~F.col("must"), F.col("layer")))
    return rows.groupBy("page").agg(F.array_join(F.array_sort(missing), ",").alias("missing"), F.array_join(F.array_sort(helps), ",").alias("would_help"), (F.size(missing) == 0).alias("ready"))
