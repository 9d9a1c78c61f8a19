"""Hierarchy roll-ups, totals, rosters and reviews (AGG-4 to 6, 8 to 18, 21, 22, 28, 32, 37, JOIN-14 to 18, 24, 27, WIN-9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lattice import spans

#: First and last number of villages of each slab.
SLABS = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4-5", 4, 5), ("6-7", 6, 7), ("8-10", 8, 10), (">10", 11, None))


def latest(metrics: DataFrame, *keys: str) -> DataFrame:
    """The value of the last period of each key; periods compare as text, blank ones come first (AGG-5)."""
    period = F.coalesce("period", F.lit(""))
    return metrics.groupBy(*keys).agg(F.max_by("value", F.struct(period, "value")).alias("value"), F.max(period).alias("period"))


def weighted_share(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the weights' sum; null without weights (AGG-6)."""
    both = F.when(value.isNotNull(), weight)
    return F.sum(value * both) / F.nullif(F.sum(both), F.lit(0))


def majority(rows: DataFrame, key: str, choice: str, weight: Column) -> DataFrame:
    """The choice with the most weight for each key, ties to the smallest (AGG-15)."""
    sums = rows.groupBy(key, choice).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(key).agg(F.max_by(choice, F.struct("weight", F.lit(0))).alias("any"), F.min_by(choice, F.struct(-F.col("weight"), choice)).alias(choice), F.max("weight").alias("weight")).drop("any")


def rolled_up(outlets: DataFrame, levels: Sequence[str], *, rep: str = "rep", value: str = "value", weight: str = "weight", share: str = "share") -> DataFrame:
    """Figures of every level of a hierarchy in one pass: ``level``, ``key``, outlets, distinct reps, sums and the
    weighted share (AGG-8, AGG-9). The level ``all`` holds the totals: distinct over everything, ratios of sums.

    Rows expand to a row for each level, so that all levels share one partial aggregation and one shuffle; reps are
    first made distinct in each group.
    """
    path = lambda k: F.concat_ws(" > ", *levels[: k + 1])
    expanded = F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("key")), *[F.struct(F.lit(name).alias("level"), path(k).alias("key")) for k, name in enumerate(levels)]))
    rows = outlets.select(expanded.alias("at"), rep, value, weight, share).select("at.*", rep, value, weight, share)
    partial = rows.groupBy("level", "key", rep).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"), F.sum(F.when(F.col(share).isNotNull(), F.col(weight))).alias("w"), F.sum(F.col(share) * F.col(weight)).alias("sw"))
    return partial.groupBy("level", "key").agg(F.sum("n").alias("outlets"), F.count(rep).alias("reps"), F.sum("v").alias("value"), (F.sum("sw") / F.nullif(F.sum("w"), F.lit(0.0))).alias("share"))


def with_fallback(rows: DataFrame, dim: DataFrame, name: str, parent: str, value: str) -> DataFrame:
    """A value by name and parent, else by the first row of that name (JOIN-14)."""
    both = dim.groupBy(name, parent).agg(F.min(value).alias("_by_both"))
    alone = dim.groupBy(name).agg(F.min_by(value, F.struct(parent, value)).alias("_by_name"))
    return rows.join(both, [name, parent], "left").join(alone, name, "left").withColumn(value, F.coalesce("_by_both", "_by_name")).drop("_by_both", "_by_name")


def roster(outlets: DataFrame, group: str, rep: str, place: str, label: str) -> DataFrame:
    """Reps of a group: outlets, distinct places, top three and most frequent label, bounds, share (AGG-13, AGG-14)."""
    labels = outlets.groupBy(group, rep, label).agg(F.count(F.lit(1)).alias("n"))
    ranks = labels.withColumn("r", F.row_number().over(Window.partitionBy(group, rep).orderBy(F.col("n").desc(), label))).where("r <= 3")
    top = ranks.groupBy(group, rep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", label))), lambda x: x[label]), ",").alias("top3"))
    each = outlets.groupBy(group, rep).agg(F.count(F.lit(1)).alias("outlets"), F.count_distinct(place).alias("places"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)])
    whole = outlets.groupBy(group).agg(F.count(F.lit(1)).alias("whole"))
    return each.join(top, [group, rep]).join(whole, group).withColumn("permille", F.floor(F.col("outlets") * 1000.0 / F.col("whole") + 0.5).cast("long")).drop("whole")


def slab(n: Column) -> Column:
    """The slab that a number of villages falls in (AGG-22)."""
    out = F.lit(None).cast("string")
    for label, low, high in SLABS:
        out = F.when((n >= low) & (F.lit(True) if high is None else n <= high), label).otherwise(out)
    return out


def slabs(outlets: DataFrame, rep: str, village: str, district: str, level: str) -> DataFrame:
    """Reps by how many villages they serve, at the level of the district where most of their outlets are (AGG-22)."""
    villages = outlets.groupBy(rep).agg(F.count_distinct(village).alias("n_villages"))
    home = majority(outlets.withColumn("_one", F.lit(1)), rep, district, F.col("_one")).select(rep, district)
    where = outlets.select(district, level).distinct().groupBy(district).agg(F.min(level).alias(level))
    return villages.join(home, rep).join(where, district).groupBy(level, slab(F.col("n_villages")).alias("slab")).agg(F.count(F.lit(1)).alias("reps"), F.sum("n_villages").alias("assignments"))


def id_conflicts(outlets: DataFrame, code: str, rep: str, brand: str, same_km: float = 0.5) -> DataFrame:
    """Outlet codes on several rows (AGG-21, JOIN-27): rows, reps, brands, the largest distance, and two findings.

    ``kind`` is of codes with several reps: ``conflict`` with one brand, else ``same place`` or ``different place`` by the
    farthest two rows. ``n_repeat`` counts rows whose brand and rep have the code more than once. Blank codes are none;
    unknown brands are one, and so are unknown reps. The farthest two are sought among the corners of a code's hull.
    """
    told = outlets.withColumns({code: F.trim(F.col(code).cast("string")), brand: F.coalesce(brand, F.lit("-")), rep: F.coalesce(F.col(rep).cast("string"), F.lit("-"))}).where(F.col(code) != "")
    each = told.groupBy(code, brand, rep).agg(F.count(F.lit(1)).alias("n"))
    codes = each.groupBy(code).agg(F.sum("n").alias("n_rows"), F.count_distinct(rep).alias("n_reps"), F.count_distinct(brand).alias("n_brands"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_repeat"))
    codes = codes.where("n_reps > 1 OR n_repeat > 0")
    several = told.join(codes.where("n_reps > 1").select(code), code, "left_semi")
    span = spans(several.select(F.col(code).alias("owner"), F.col("lon").alias("x"), F.col("lat").alias("y"))).withColumnRenamed("owner", code)
    place = F.when(F.col("far_m") <= same_km * 1000, "same place").otherwise("different place")
    kind = F.when(F.col("n_reps") > 1, F.when(F.col("n_brands") < 2, "conflict").otherwise(place))
    return codes.join(span, code, "left").withColumn("kind", kind)


def gaps(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows without a partner (JOIN-18, SET-4)."""
    return rows.join(others.select(*keys).distinct(), list(keys), "left_anti")


def bounds(rows: DataFrame, *by: str) -> DataFrame:
    """Bounding boxes (AGG-28)."""
    return rows.groupBy(*by).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)])


def tree(rows: DataFrame, *levels: str) -> DataFrame:
    """Counts nested as deep as there are levels (AGG-17): a row for each name of the first one, with ``n`` and ``children``
    (name, n, children) in name order. A node's children are as many as the names below it."""
    out = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    for k in range(len(levels) - 1, 0, -1):
        child = [F.col(levels[k]).alias("name"), F.col("n"), *([F.col("children")] if "children" in out.columns else [])]
        out = out.groupBy(*levels[:k]).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(*child))).alias("children"))
    return out


def options(rows: DataFrame, column: str, others: Column) -> DataFrame:
    """Values of a filter that are left under the other filters (AGG-32)."""
    return rows.where(others).agg(F.array_sort(F.collect_set(column)).alias("options"))


def agreement(a: DataFrame, b: DataFrame, key: str, choice: str) -> DataFrame:
    """How many keys two assignments share, and where they differ (AGG-16, SET-3)."""
    both = a.select(key, F.col(choice).alias("x")).join(b.select(key, F.col(choice).alias("y")), key)
    return both.agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("x") != F.col("y")).alias("n_differ"))
