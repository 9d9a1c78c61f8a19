"""Percentile scoring of areas with gates and ranks (WIN-1 to 5, SCR-1 to 6, AGG-25 to 27, 33)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.functions.geo import distance_ramp

from .order import numbered, percentiles

#: Fixed values of the scoring model.
TERM_WEIGHTS = {"population": 0.20, "vlr_total": 0.20, "ms_score": 0.12, "cvi": 0.28, "cpi": 0.12, "network": 0.08}
VITALITY_WEIGHTS = {"finance": 0.35, "minimarket": 0.35, "pasar": 0.30}
FINANCE_WEIGHTS = {"atm_den": 0.60, "bank_den": 0.40}
COMPETITION_WEIGHTS = {"primary": 0.65, "comp_den": 0.35}
NETWORK_WEIGHTS = {"vlr_per_site": 0.60, "site_count": 0.40}
PASAR_MIN_COVERAGE = 0.60
CANDIDATE_WEIGHTS = {"district": 0.50, "local": 0.50}


@dataclass(frozen=True)
class Params:
    """Settings of a run; ``merged`` takes them as text and ignores names it doesn't know (SCR-1)."""

    strategy: str = "DENSIFY"
    gates: bool = True
    vlr_min: float = 80000.0
    vlr_pct_min: float = 40.0
    ms_pct_min: float = 40.0
    ms_pct_max: float = 50.0
    dist_term: bool = True
    dist_weight: float = 0.15
    dist_zero_km: float = 2.0
    dist_full_km: float = 15.0
    min_km_hybrid: float = 10.0
    min_km_im3: float = 10.0
    min_km_3id: float = 10.0
    g1_mode: str = "min"
    hybrid_own: bool = True
    use_cpi: bool = False
    pop_metric: str = "density"
    scope: str = "stratum"
    top_n: int = 25

    def merged(self, told: Mapping[str, object]) -> Params:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        known = {k: v for k, v in told.items() if k in kinds and v not in (None, "")}
        read = {bool: lambda v: v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes", "on"), int: int, float: float, str: str}
        out = {k: read[kinds[k]](v) for k, v in known.items()}
        if "strategy" in out:
            out["strategy"] = out["strategy"].upper() if out["strategy"].upper() in ("DENSIFY", "ATTACK") else "DENSIFY"
        for name, usual, other in (("pop_metric", "density", "total"), ("g1_mode", "min", "max"), ("scope", "stratum", "territory")):
            if name in out:
                out[name] = other if out[name].lower() == other else usual
        return replace(self, **out)


def percentile(value: Column, *partition: str | Column) -> Column:
    """Average position among the known values of a partition that fits a task, from 0 to 1; 0.5 alone or unknown
    (WIN-1, WIN-2). Over whole tables ``order.percentiles`` gives the same."""
    groups = [*partition, value.isNotNull()]
    order = Window.partitionBy(*groups).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, value))
    place = (F.rank().over(order) - 1 + (ties - 1) / 2.0) / (n - 1)
    return F.when(value.isNull() | (n == 1), 0.5).otherwise(place)


def percentile_against(rows: DataFrame, sample: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """Middle position of values in another sample of the group, 0.5 where that is empty (WIN-3).

    Both are ordered in one window over (group), so no pair of them is compared.
    """
    both = rows.select(group, value).distinct().withColumn("w", F.lit(0)).union(sample.select(group, value).withColumn("w", F.lit(1))).where(F.col(value).isNotNull())
    totals = both.groupBy(group, value).agg(F.sum("w").alias("same"))
    w = Window.partitionBy(group)
    below = F.coalesce(F.sum("same").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("same").over(w)
    placed = totals.select(group, value, F.when(n > 0, (below + below + F.col("same")) / 2.0 / n).otherwise(0.5).alias(out))
    return rows.join(placed, [group, value], "left").withColumn(out, F.coalesce(out, F.lit(0.5)))


def renormalised(weights: Mapping[str, float], available: Mapping[str, bool], distance_weight: float = 0.0) -> dict[str, float]:
    """Weights of the available terms, which share what the distance term leaves (SCR-2)."""
    kept = {k: w for k, w in weights.items() if available.get(k, True)}
    top = max(0.0, min(0.9, distance_weight))
    out = {k: w / sum(kept.values()) * (1 - top) for k, w in kept.items()} if kept else {}
    return out | ({"distance": top} if top else {})


def availability(rows: DataFrame, least: Mapping[str, float], seen: Mapping[str, Column]) -> dict[str, bool]:
    """Which terms enough rows can tell (AGG-27): the share of rows where ``seen`` holds is at least ``least``."""
    shares = rows.agg(*[F.avg(c.cast("double")).alias(k) for k, c in seen.items()]).first()
    return {k: (shares[k] or 0.0) >= least.get(k, 0.0) and bool(shares[k]) for k in seen}


def densities(rows: DataFrame, counts: Sequence[str], area: str = "area_km2") -> DataFrame:
    """Counts per km2, voice share and the gap to market share (AGG-33): null where nothing was measured."""
    per = {f"{c}_den": F.when(F.col(area) > 0, F.col(c) / F.col(area)).otherwise(0.0) for c in counts}
    stores = F.col("own_stores") + F.col("comp_stores")
    rows = rows.withColumns(per | {"retail_sov": F.when(stores > 0, F.col("own_stores") / stores)})
    return rows.withColumn("rsov_gap", F.col("ms_ioh") - F.col("retail_sov"))


def supported(rows: DataFrame, p: Params) -> dict[str, bool]:
    """Which terms, and parts of the vitality, rows and settings support (AGG-27); ``distance`` among them."""
    some = lambda c: F.coalesce(c, F.lit(False))
    seen = {
        "population": F.col("population").isNotNull(),
        "vlr_total": some(F.col("vlr") != 0),
        "ms_score": F.col("ms_ioh").isNotNull(),
        "cpi": some(F.col("own_stores") > 0) | some(F.col("comp_stores") > 0),
        "network": some(F.col("site_count") != 0),
        "pasar": some(F.col("pasar_n") > 0),
        "distance": F.col("km_hybrid").isNotNull(),
    }
    found = availability(rows, {"pasar": PASAR_MIN_COVERAGE}, seen)
    return found | {"cpi": found["cpi"] and p.use_cpi, "distance": found["distance"] and p.dist_term}


def terms(p: Params, r: Callable[[str], Column], available: Mapping[str, bool]) -> dict[str, Column]:
    """The model's terms from percentiles (WIN-4): ``r`` gives that of an input."""
    densify = p.strategy == "DENSIFY"
    parts = {"finance": sum(r(k) * w for k, w in FINANCE_WEIGHTS.items()), "minimarket": r("minimarket_den"), "pasar": r("pasar_den")}
    primary = r("rsov_gap") if densify else 1 - r("retail_sov")
    return {
        "population": F.when(F.col("population").isNotNull(), r("population" if p.pop_metric == "total" else "pop_density")),
        "vlr_total": r("vlr"),
        "ms_score": r("ms_ioh") if densify else 1 - r("ms_ioh"),
        "cvi": sum(parts[k] * w for k, w in renormalised(VITALITY_WEIGHTS, {"pasar": available["pasar"]}).items()),
        "cpi": primary * COMPETITION_WEIGHTS["primary"] + r("comp_den") * COMPETITION_WEIGHTS["comp_den"],
        "network": sum(r(k) * w for k, w in NETWORK_WEIGHTS.items()),
        "distance": distance_ramp(F.col("km_hybrid" if p.hybrid_own else "km_own"), p.dist_zero_km, p.dist_full_km),
    }


#: Inputs that enter the model as percentiles.
RANKED = ("population", "pop_density", "vlr", "ms_ioh", "rsov_gap", "retail_sov", "comp_den", "atm_den", "bank_den", "minimarket_den", "pasar_den", "vlr_per_site", "site_count")


def rounded(value: Column, digits: int) -> Column:
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def scored(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Scores within strata and over all, gates, eligibility and ranks (WIN-4, WIN-5, SCR-3, SCR-4).

    Rows need ``area_key``, which tells them apart, ``profile`` and the inputs that ``supported``, ``terms`` and
    ``gate_fails`` name. A term that too few rows tell shares its weight among the others; one that a single row lacks is
    left out of its sum; an unknown ``vlr`` ranks as 0, other unknown inputs in the middle. Scores have two digits,
    percentiles of gates one; equal scores rank by key.
    """
    available = supported(rows, p)
    weights = renormalised(TERM_WEIGHTS, available, p.dist_weight if available["distance"] else 0.0)
    values = {c: F.col(c) for c in RANKED} | {"vlr": F.coalesce("vlr", F.lit(0.0))}
    places = percentiles(rows, "area_key", values, {"all": F.lit(""), "profile": F.col("profile")})
    rows = rows.join(places, "area_key", "left")
    r = lambda scope: lambda c: F.coalesce(F.col(f"`{c}@{scope}`"), F.lit(0.5))
    total = lambda scope: rounded(sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in terms(p, r(scope), available).items() if k in weights), F.lit(0.0)) * 100, 2)
    ms_pct = F.when(F.col("ms_ioh").isNotNull(), rounded(r("all")("ms_ioh") * 100, 1))
    rows = rows.withColumns({"score_stratum": total("profile"), "score_territory": total("all"), "vlr_pct": rounded(r("all")("vlr") * 100, 1), "ms_pct": ms_pct}).drop(*[c for c in places.columns if c != "area_key"])
    rows = rows.withColumn("gate_fails", gate_fails(p))
    rows = rows.withColumn("eligible", (F.size("gate_fails") == 0) | (not p.gates))
    chosen, other = ("score_stratum", "score_territory") if p.scope == "stratum" else ("score_territory", "score_stratum")
    rows = rows.withColumns({"score": F.when(F.col("eligible"), F.col(chosen)), "score_other": F.col(other)})
    return ranked(rows, "score", "area_key", "profile")


def gate_fails(p: Params) -> Column:
    """Names of the gates a row fails (SCR-3): a limit of 0 opens a gate, and the distance gate is shut off by the distance term."""
    limits = {"km_hybrid": p.min_km_hybrid} if p.hybrid_own else {"km_im3": p.min_km_im3, "km_3id": p.min_km_3id}
    far = [F.coalesce(F.col(k) > v if p.g1_mode == "max" else F.col(k) < v, F.lit(False)) for k, v in limits.items() if v and not p.dist_term]
    share, limit = (F.col("ms_pct") < p.ms_pct_min, p.ms_pct_min) if p.strategy == "DENSIFY" else (F.col("ms_pct") > p.ms_pct_max, p.ms_pct_max)
    gates = {
        "distance": reduce(Column.__or__, far, F.lit(False)),
        "vlr": (F.coalesce(F.col("vlr"), F.lit(0.0)) < p.vlr_min) & bool(p.vlr_min),
        "vlr_pct": (F.col("vlr_pct") < p.vlr_pct_min) & bool(p.vlr_pct_min),
        "share": share & bool(limit),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(k)) for k, test in gates.items()]))


def ranked(rows: DataFrame, score: str, key: str, group: str) -> DataFrame:
    """Ranks from 1 by descending score, overall and in the group; null without a score (WIN-5)."""
    order = [F.col("_no_score"), F.col(score).desc(), F.col(key)]
    rows = numbered(rows.withColumn("_no_score", F.col(score).isNull()), order, "rank")
    rows = numbered(rows, order, "rank_in_profile", [group])
    return rows.withColumns({c: F.when(~F.col("_no_score"), F.col(c)) for c in ("rank", "rank_in_profile")}).drop("_no_score")


def gate_counts(rows: DataFrame) -> DataFrame:
    """How many rows pass each gate by itself (AGG-25), from ``gate_fails``."""
    gates = ("distance", "vlr", "vlr_pct", "share")
    counts = rows.agg(*[F.count_if(~F.array_contains("gate_fails", g)).alias(g) for g in gates])
    return counts.unpivot([], list(gates), "gate", "passes")


def summary(rows: DataFrame) -> DataFrame:
    """Counts and means of a ranking (AGG-26)."""
    # of hundredths, which are whole numbers, so that the order of adding them up doesn't matter
    mean = lambda c: F.floor(F.sum(F.floor(c * 100.0 + 0.5)) / F.count(c) + 0.5).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_eligible"), mean(F.col("score")).alias("mean_x100"), mean(F.when(F.col("profile") == "urban", F.col("score"))).alias("urban_x100"), mean(F.when(F.col("profile") == "rural", F.col("score"))).alias("rural_x100"))


def candidate_score(district: Column, local: Column) -> Column:
    """Half the district's score, none if it has no score, half the local vitality (SCR-5)."""
    return F.coalesce(district, F.lit(0.0)) * CANDIDATE_WEIGHTS["district"] + local * 100 * CANDIDATE_WEIGHTS["local"]


def breakdown(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Terms with weights and points, heaviest first (SCR-6)."""
    order = sorted((k for k in parts if k in weights), key=lambda k: -weights[k])
    made = [F.when(parts[k].isNotNull(), F.struct(F.lit(k).alias("term"), F.lit(weights[k]).alias("weight"), (parts[k] * weights[k] * 100).alias("points"))) for k in order]
    return F.array_compact(F.array(*made))
