"""Outlets far from their rep's others, and who could take them (JOIN-19, AGG-23, GEO-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial import inside, near, nearest

#: Kilometres that are still acceptable by stratum, how far to look for another rep, from where on a
#: position is taken for wrong, a full load, what a full rep's distance counts more, and what one's own ground counts.
LIMIT_KM = {"urban": 1.5, "rural": 4.0}
SEARCH_KM = 20.0
WRONG_KM = 50.0
FULL_LOAD = 50
FULL_KM = 100.0
INSIDE = 0.5


def limit_km(stratum: Column) -> Column:
    """The distance to the nearest own outlet that a stratum allows."""
    return F.when(stratum == "urban", LIMIT_KM["urban"]).otherwise(LIMIT_KM["rural"])


def strays(outlets: DataFrame, limit: Column, reach_km: float = 5.0) -> DataFrame:
    """Outlets whose nearest other outlet of the same rep is farther than the limit: ``km_own``, and ``wrong`` where that is
    so far that the position must be mistaken.

    Reps with one outlet have no other to be far from and are left out. Only outlets without another one within
    ``reach_km`` look farther, twice as far in each round.
    """
    many = outlets.groupBy("rep").agg(F.count(F.lit(1)).alias("load")).where("load > 1")
    rows = outlets.join(many, "rep")
    spots = rows.select("point_id", "rep", "lon", "lat")
    own = nearest(spots, spots, reach_km * 1000, within=["rep"], other=True).select("point_id", (F.col("metres") / 1000).alias("km_own"))
    rows = rows.join(own, "point_id")
    return rows.where(F.col("km_own") > limit).withColumn("wrong", F.col("km_own") > WRONG_KM)


def offers(stray: DataFrame, outlets: DataFrame, reach_km: float = SEARCH_KM) -> DataFrame:
    """The nearest outlet of each other rep within reach of each stray: ``to``, ``km_new``, ``to_load``."""
    loads = outlets.groupBy(F.col("rep").alias("to")).agg(F.count(F.lit(1)).alias("to_load"))
    pairs = near(stray.select("point_id", "rep", "km_own", "lon", "lat"), outlets.select("point_id", "rep", "lon", "lat"), reach_km * 1000).where("rep <> r_rep")
    best = pairs.groupBy("point_id", "rep", "km_own", F.col("r_rep").alias("to")).agg((F.min("metres") / 1000).alias("km_new"))
    return best.join(loads, "to")


def seams(outlets: DataFrame, borders: DataFrame) -> DataFrame:
    """Outlets that stand on another rep's ground (GEO-18): ``point_id``, ``owner``. ``borders``: owner, pos, rings; an outlet in
    several is on the first one's."""
    hit = inside(outlets.select("point_id", "rep", "lon", "lat"), borders, how="first")
    return hit.where("owner <> rep").select("point_id", "owner")


def receivers(offered: DataFrame, ground: DataFrame | None = None) -> DataFrame:
    """Which rep takes each stray: ``point_id``, ``to``, ``km_new``, ``to_load`` (with what it has been given), or none if no
    move makes the way shorter.

    Strays choose one after the other, by sending rep and id; the nearest rep is preferred, one whose ground the
    stray stands on (``ground``: point_id, to) at half the distance, a full one only if no other is near. What a rep has
    been given before counts, so that a choice depends on earlier ones, but only by which reps are full by then. So all
    choose at once, first as if nobody filled up; from the choices follows when each rep is full, all choose again, and so
    on until those times stay. Each round settles at least the next rep to fill up, and all that don't touch each other.
    """
    rows = offered.withColumn("inside", F.lit(False))
    if ground is not None:
        mark = ground.select("point_id", "to", F.lit(True).alias("_inside"))
        rows = offered.join(mark, ["point_id", "to"], "left").withColumn("inside", F.coalesce("_inside", F.lit(False))).drop("_inside")
    rows = rows.withColumn("turn", F.struct("rep", "point_id")).checkpoint()
    full: DataFrame | None = None
    while True:
        told = rows.withColumn("full_at", F.lit(None).cast(rows.schema["turn"].dataType)) if full is None else rows.join(full, "to", "left")
        is_full = (F.col("to_load") >= FULL_LOAD) | F.coalesce(F.col("turn") > F.col("full_at"), F.lit(False))
        score = F.col("km_new") * F.when(F.col("inside"), INSIDE).otherwise(1.0) + F.when(is_full, FULL_KM).otherwise(0.0)
        best = told.groupBy("point_id").agg(F.min_by(F.struct("turn", "to", "km_new", "km_own", "to_load"), F.struct(score, "to")).alias("best")).select("point_id", "best.*")
        taken = best.where("km_new < km_own").checkpoint()
        # the last one that a rep can take before it is full
        order = Window.partitionBy("to").orderBy("turn")
        new = taken.where(F.col("to_load") < FULL_LOAD).withColumn("n", F.row_number().over(order)).where(f"n <= {FULL_LOAD}").where(f"n = {FULL_LOAD} - to_load").select("to", F.col("turn").alias("full_at")).checkpoint()
        known = new.limit(0) if full is None else full
        if new.exceptAll(known).isEmpty() and known.exceptAll(new).isEmpty():
            break
        full = new
    load = F.col("to_load") + F.row_number().over(order)
    moved = taken.select("point_id", "to", "km_new", load.alias("to_load"))
    return rows.select("point_id").distinct().join(moved, "point_id", "left")


def totals(outlets: DataFrame, stray: DataFrame, moved: DataFrame, stratum: str, branch: str) -> DataFrame:
    """The review in numbers (AGG-23), as rows of ``what`` and ``n``: outlets and strays by stratum, reps, those over a full
    load and those with strays, wrong positions, strays nobody nearer could take, metres saved, and the six branches
    with the most strays (``branch: name``)."""
    whole = outlets.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(stratum) == "urban").alias("urban"))
    whole = whole.agg(F.sum("n").alias("outlets"), F.sum("urban").alias("urban"), F.count("rep").alias("reps"), F.count_if(F.col("n") > FULL_LOAD).alias("reps_over"))
    whole = whole.withColumn("rural", F.col("outlets") - F.col("urban"))
    found = stray.where("NOT wrong").join(moved.select("point_id", "to", "km_new"), "point_id", "left")
    flags = found.agg(F.count(F.lit(1)).alias("strays"), F.count_if(F.col(stratum) == "urban").alias("strays_urban"), F.count_if(F.col(stratum) != "urban").alias("strays_rural"), F.count_distinct("rep").alias("reps_flagged"), F.count_if(F.col("to").isNull()).alias("no_receiver"), F.coalesce(F.sum(F.floor((F.col("km_own") - F.col("km_new")) * 1000 + 0.5)), F.lit(0)).alias("metres_saved"))
    wrong = stray.agg(F.count_if("wrong").alias("wrong"))
    rows = [t.unpivot([], t.columns, "what", "n").select("what", F.col("n").cast("long").alias("n")) for t in (whole, flags, wrong)]
    top = found.groupBy(F.coalesce(branch, F.lit("-")).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "b").limit(6)
    return rows[0].union(rows[1]).union(rows[2]).union(top.select(F.concat(F.lit("branch: "), F.col("b").cast("string")), "n"))
