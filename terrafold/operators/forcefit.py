"""Whole villages dealt to reps and rebalanced (GEO-13, SCR-8, JOIN-30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Villages (least, most, outlier) and outlets (least, most) of a rep, by stratum.
NORMS = {"urban": (1, 3, 4, 50, 70), "rural": (1, 5, 7, 50, 60)}
#: Rounds at most; each does the best move of all and many others.
MOST_ROUNDS = 400


def violation(villages: Column, outlets: Column, stratum: Column) -> Column:
    """How far a rep is outside the norms (SCR-8): villages over the outlier bound count three times, 20 outlets as a village."""

    def of(s: str) -> Column:
        low, high, outlier, least, most = NORMS[s]
        over = (villages - high) * F.when(villages > outlier, 3.0).otherwise(1.0)
        v = F.when(villages > high, over).when(villages < low, low - villages).otherwise(0.0)
        return v + F.greatest(F.lit(0), outlets - most, least - outlets) / 20.0

    return F.when(stratum == "urban", of("urban")).otherwise(of("rural"))


def state(villages: DataFrame) -> DataFrame:
    """Each owner's villages, outlets and stratum (rural if more than half of the villages are), with the violation."""
    sums = villages.groupBy("owner").agg(F.count(F.lit(1)).alias("n_villages"), F.sum("outlets").alias("n_outlets"), F.count_if(F.col("stratum") == "rural").alias("n_rural"))
    sums = sums.withColumn("stratum", F.when(F.col("n_rural") * 2 > F.col("n_villages"), "rural").otherwise("urban"))
    return sums.withColumn("violation", violation(F.col("n_villages"), F.col("n_outlets"), F.col("stratum")))


def improvements(villages: DataFrame, both: DataFrame) -> DataFrame:
    """Moves (``village``, ``a`` to ``b``) of villages to a neighbour's owner that lessen the two owners' violation, with ``gain``.
    An owner that a village had before (``had``) doesn't get it again; strata of owners count as they are before a move."""
    held = state(villages)
    side = lambda k: held.select(F.col("owner").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n_villages", "n_outlets", "stratum", "violation")])
    own = villages.select("village", F.col("owner").alias("a"), "outlets", "had")
    near = villages.select(F.col("village").alias("n"), F.col("owner").alias("b"))
    rows = both.join(own, both["x"] == own["village"]).join(near, both["y"] == near["n"]).where("a <> b AND NOT array_contains(had, b)")
    rows = rows.select("village", "a", "b", "outlets").distinct().join(side("a"), "a").join(side("b"), "b")
    left = violation(F.col("a_n_villages") - 1, F.col("a_n_outlets") - F.col("outlets"), F.col("a_stratum"))
    got = violation(F.col("b_n_villages") + 1, F.col("b_n_outlets") + F.col("outlets"), F.col("b_stratum"))
    return rows.select("village", "a", "b", "outlets", (F.col("a_violation") + F.col("b_violation") - left - got).alias("gain")).where("gain > 1e-9")


def rebalanced(villages: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(village, was, owner) after moves of border villages that lessen the violation (GEO-13).

    Villages have ``village``, ``owner``, ``outlets``, ``stratum``; adjacency has pairs (a, b). In each round every owner names the
    best move that it is a part of: the largest gain, then the fewest outlets, then the smallest names. What both its
    owners name is done, all over the map at once, as such moves don't touch each other. Every round lessens the sum, by
    the best move of all at least, until nothing does; rounds are checkpointed.
    """
    both = adjacency.select(F.col("a").alias("x"), F.col("b").alias("y")).union(adjacency.select("b", "a")).distinct().checkpoint()
    kind = villages.schema["owner"].dataType.simpleString()
    rows = villages.select("village", F.col("owner").alias("was"), "owner", "outlets", "stratum", F.array().cast(f"array<{kind}>").alias("had")).checkpoint()
    for _ in range(MOST_ROUNDS):
        order = F.struct(-F.col("gain"), "outlets", "village", "b")
        named = improvements(rows, both).withColumn("o", F.explode(F.array("a", "b"))).groupBy("o").agg(F.min_by(F.struct("village", "a", "b"), order).alias("move"))
        moves = named.groupBy("move").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("move.village").alias("v"), F.col("move.b").alias("to")).checkpoint()
        if moves.isEmpty():
            break
        rows = rows.join(moves, rows["village"] == moves["v"], "left")
        rows = rows.withColumn("had", F.when(F.col("to").isNotNull(), F.array_append("had", F.col("owner"))).otherwise(F.col("had"))).withColumn("owner", F.coalesce("to", "owner")).drop("v", "to").checkpoint()
    return rows.select("village", "was", "owner")
