"""Base rows of districts, point unions, service points, stamps and status counts
(AGG-7, 18, 24, 34, 35, FLT-6, 8, 10, 11, 12, 16, JOIN-29, 32, 33, SRC-33, SNK-21)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.classify import golden_hue, hex_colour, service_point
from terrafold.functions.geo import on_map
from terrafold.functions.text import norm_key, place_key

from .order import numbered
from .spatial import inside, nearest, thinned

#: Which parts of a file's name tell its role, first ones first; roles of layers that have none.
ROLE_PARTS = (("dse", "outlet"), ("outlet", "outlet"), ("site", "site"), ("bts", "site"), ("tower", "site"), ("service point", "service"), ("service_point", "service"), ("mc36", "mc"), ("mc_", "mc"), ("microcluster", "mc"), ("desa", "desa"), ("kel", "desa"), ("kec", "kec"), ("city border", "kec"), ("kabupaten", "kec"))
LAYER_ROLES = {"kecamatan": "kec", "kelurahan": "desa", "desa": "desa", "indosat_mc": "mc", "mc": "mc", "microcluster": "mc"}
#: The roles that each domain shows.
DOMAINS = {"gapura": ("mc", "kec", "desa", "service", "other"), "distribution": ("mc", "kec", "desa", "outlet", "site", "other"), "baseline": ("mc", "kec", "desa")}
#: Fields that tell a kind of boundary, most specific first.
BOUNDARY_FIELDS = (("desa", ("KEL_DES",)), ("mc36", ("MC36",)), ("mcagus", ("MC_IOH",)), ("kecamatan", ("KEC", "KABKOT")))


def folded(name: Column) -> Column:
    """How names of places are compared: trimmed, in upper case, blank for unknown."""
    return F.upper(F.trim(F.coalesce(name, F.lit(""))))


def chosen(filters: Mapping[str, str | None]) -> Column:
    """Whether the columns named hold what was asked for, by folded names; what wasn't asked for doesn't count (FLT-8)."""
    test = F.lit(True)
    for column, wanted in filters.items():
        if wanted and wanted.strip():
            test = test & (folded(F.col(column)) == wanted.strip().upper())
    return test


def scoped(rows: DataFrame, column: str, wanted: Sequence[str], clip: bool) -> DataFrame:
    """Rows of the wanted provinces, by folded names, or all rows with ``outside`` (FLT-6); unknown ones are outside."""
    test = folded(F.col(column)).isin(*[w.strip().upper() for w in wanted])
    return rows.where(test) if clip else rows.withColumn("outside", ~test)


def admitted(rows: DataFrame, allowed: DataFrame, territory: DataFrame, column: str) -> DataFrame:
    """Rows whose name is allowed, and those that the territory doesn't know at all, marked ``outside`` (FLT-10)."""
    names = lambda t, tag: t.select(folded(F.col(column)).alias("_name"), F.lit(True).alias(tag)).distinct()
    known = names(territory, "_known").join(names(allowed, "_allowed"), "_name", "full")
    told = rows.withColumn("_own", folded(F.col(column))).join(known, F.col("_own") == F.col("_name"), "left")
    told = told.withColumn("outside", F.col("_known").isNull() & F.col("_allowed").isNull())
    return told.where(F.col("outside") | F.col("_allowed").isNotNull()).select(*rows.columns, "outside")


def village_stats(villages: DataFrame, sites: DataFrame, districts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Figures of each village and of each microcluster (AGG-18): sites, people and km2; villages find their ``mc`` by district."""
    n = sites.groupBy("village").agg(F.count(F.lit(1)).alias("sites"))
    mc = districts.select(folded(F.col("district")).alias("_d"), "mc").groupBy("_d").agg(F.min("mc").alias("mc"))
    rows = villages.join(n, "village", "left").join(mc, folded(F.col("district")) == F.col("_d"), "left").drop("_d")
    rows = rows.withColumns({"sites": F.coalesce("sites", F.lit(0)), "population": F.coalesce("population", F.lit(0)), "area_km2": F.coalesce("area_m2", F.lit(0)) / 1e6}).drop("area_m2")
    return rows, rows.groupBy("mc").agg(F.count(F.lit(1)).alias("villages"), *[F.sum(c).alias(c) for c in ("sites", "population", "area_km2")])


def base_rows(districts: DataFrame, villages: DataFrame, placed: DataFrame | None, named: DataFrame) -> DataFrame:
    """What the roll-up of each district starts from (AGG-7).

    ``districts``: key, name, parent. ``villages``: name, parent, population, area_m2, geo. ``placed`` (by geometry) and ``named``
    (by the names in the export): name, parent, outlets, reps, value. Where there is geometry at all it wins, and a
    district without a point has zeros; otherwise the export's names count. ``has_data`` asks either. Names are folded,
    and names without a district fall out.
    """
    keys = lambda t: t.withColumns({"name": folded(F.col("name")), "parent": folded(F.col("parent"))})
    rows = districts.withColumns({"_n": folded(F.col("name")), "_p": folded(F.col("parent"))})
    kinds = keys(villages).groupBy("name", "parent", "geo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("population", F.lit(0))).alias("pop"), F.sum(F.coalesce("area_m2", F.lit(0))).alias("m2"))
    # kinds of ground are few, whatever the number of villages
    mix = F.array_sort(F.collect_list(F.when(F.col("geo").isNotNull() & (F.col("geo") != ""), F.struct("geo", "n"))))
    land = kinds.groupBy("name", "parent").agg(F.sum("n").alias("n_villages"), F.sum("pop").alias("population"), (F.sum("m2") / 1e6).alias("area_km2"), mix.alias("geo"))
    sums = lambda t, tag: keys(t).groupBy("name", "parent").agg(*[F.sum(c).alias(tag + c) for c in ("outlets", "reps", "value")])
    geometry = placed is not None and not placed.isEmpty()
    sides = [land, sums(named, "n_")] + ([sums(placed, "g_")] if geometry else [])
    for side in sides:
        rows = rows.join(side, (rows["_n"] == side["name"]) & (rows["_p"] == side["parent"]), "left").drop(side["name"], side["parent"])
    own = "g_" if geometry else "n_"
    has = F.col("n_outlets").isNotNull() | F.col(own + "outlets").isNotNull()
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind)
    return rows.select(*districts.columns, zero("n_villages").alias("n_villages"), zero("population").alias("population"), F.coalesce("area_km2", F.lit(0.0)).alias("area_km2"), F.coalesce("geo", F.array().cast("array<struct<geo:string,n:bigint>>")).alias("geo"), *[zero(own + c).alias(c) for c in ("outlets", "reps", "value")], has.alias("has_data"))


def role(layer: Column, file: Column) -> Column:
    """The role of a layer by its key, else by its file's name, else by parts of its key."""
    def by_name(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for part, name in reversed(ROLE_PARTS):
            out = F.when(F.contains(F.lower(text), F.lit(part)), name).otherwise(out)
        return out

    known = F.lit(None).cast("string")
    for key, name in LAYER_ROLES.items():
        known = F.when(layer == key, name).otherwise(known)
    return F.coalesce(known, by_name(file), by_name(layer), F.lit("other"))


def visible(domain: str | None, layer: Column, file: Column) -> Column:
    """Whether a layer may be shown in a domain; an unknown domain shows all (FLT-11)."""
    roles = DOMAINS.get((domain or "").strip().lower())
    return role(layer, file).isin(*roles) if roles else F.lit(True)


def boundary_kind(fields: Column) -> Column:
    """The kind of boundary that an array of field names tells (FLT-16)."""
    up = F.transform(fields, lambda f: F.upper(f))
    out = F.lit("unknown")
    for kind, needs in reversed(BOUNDARY_FIELDS):
        out = F.when(F.size(F.array_intersect(up, F.array(*map(F.lit, needs)))) == len(needs), kind).otherwise(out)
    return out


def refused(kind: Column, allowed: Sequence[str]) -> Column:
    """Why a slot refuses a kind of boundary; null where it takes it (FLT-16)."""
    swap = F.when((kind == "mcagus") & F.lit("mc36" in allowed), "replaces the primary cut")
    return F.when(~kind.isin(*allowed), F.coalesce(swap, F.when(kind != "unknown", F.concat(F.lit("belongs in another slot: "), kind)), F.lit("no field tells a boundary")))


def searched(rows: DataFrame, text: str, columns: Sequence[str], slice_: DataFrame | None = None, district: str = "district", cap: int = 300, by: str = "point_id") -> DataFrame:
    """Rows of the districts in ``slice_`` whose columns together hold the text, by key, the first ``cap`` (FLT-12)."""
    if slice_ is not None:
        allowed = slice_.select(norm_key(F.col(district)).alias("_k")).distinct()
        rows = rows.withColumn("_k", norm_key(F.col(district))).join(allowed, "_k", "left_semi").drop("_k")
    wanted = norm_key(F.lit(text))
    return rows.where((wanted == "") | F.contains(norm_key(*[F.col(c).cast("string") for c in columns]), wanted)).orderBy(by).limit(cap)


def imported(features: DataFrame, existing: DataFrame) -> DataFrame:
    """Service points after an import (SRC-33): ``features`` (seq, raw, folder, name, kind, lat, lon) are classified and keyed
    by content, of equal keys the first stays; keys of older schemes go, equal keys are replaced."""
    operator, group = service_point(F.col("raw"), F.col("folder"), F.col("name"), F.col("kind"))
    new = features.select("seq", place_key(F.coalesce("name", F.lit("")), F.col("lat"), F.col("lon")).alias("key"), operator.alias("operator"), group.alias("class"), "name", "lat", "lon")
    new = new.groupBy("key").agg(F.min_by(F.struct("operator", "class", "name", "lat", "lon"), "seq").alias("one")).select("key", "one.*")
    kept = existing.where(F.startswith("key", F.lit("sp:")) | F.startswith("key", F.lit("store:")))
    return new.unionByName(kept.join(new, "key", "left_anti").select(new.columns))


def seeded(stores: DataFrame, existing: DataFrame) -> DataFrame:
    """Service points with the own stores among them, keyed by the stores' keys, so that seeding twice changes nothing (SNK-21)."""
    new = stores.where("lat IS NOT NULL").select(F.concat(F.lit("store:"), F.col("store").cast("string")).alias("key"), F.lit("IM3").alias("operator"), F.lit("operator").alias("class"), "name", "lat", "lon")
    return new.unionByName(existing.join(new, "key", "left_anti").select(new.columns))


def stamped(sites: DataFrame, coverage: DataFrame, outlets: DataFrame, villages: DataFrame, reach_m: float = 5000.0) -> DataFrame:
    """Where each site lies and whose it is (JOIN-29): ``assigned`` by the coverage polygon it is in (``mode`` polygon), else by
    the nearest outlet (nearest), the village by its polygon, and ``mismatch`` where the site's own ``rep`` says otherwise."""
    spots = sites.select("point_id", "lon", "lat")
    rows = sites.join(inside(spots, coverage.select(F.col("key").alias("by_area"), "pos", "rings"), how="first").select("point_id", "by_area"), "point_id", "left")
    rows = rows.join(inside(spots, villages.select(F.col("key").alias("village"), "pos", "rings"), how="first").select("point_id", "village"), "point_id", "left")
    close = nearest(rows.where("by_area IS NULL").select("point_id", "lon", "lat"), outlets.select("point_id", "lon", "lat"), reach_m).select("point_id", "nearest_id")
    close = close.join(outlets.select(F.col("point_id").alias("nearest_id"), F.col("rep").alias("by_near")), "nearest_id").select("point_id", "by_near")
    rows = rows.join(close, "point_id", "left").withColumn("assigned", F.coalesce("by_area", "by_near"))
    mode = F.when(F.col("by_area").isNotNull(), "polygon").when(F.col("by_near").isNotNull(), "nearest")
    return rows.select(*sites.columns, "assigned", mode.alias("mode"), "village", F.coalesce(F.col("rep") != F.col("assigned"), F.lit(False)).alias("mismatch"))


def all_points(outlets: DataFrame, sites: DataFrame, registry: DataFrame, pois: DataFrame, hierarchy: DataFrame, filters: Mapping[str, str] | None = None, districts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Outlets, sites and other places of a slice as one table (JOIN-32): ``cls``, ``id``, ``name``, ``district``, ``city``, ``in_territory``.

    Points have ``id``, ``name``, ``district``, ``city``, ``lon``, ``lat``; sites also ``site``, an id of which the first row (by ``seq``) counts, and
    the registry only adds sites whose id none has. ``hierarchy``: district, city (blank: any), mc, branch, area. With filters
    a site without a district gets that of the polygon it lies in (``districts``: key, parent, pos, rings). Points off the
    map are left out. More than ``most`` are thinned evenly.
    """
    asked = {k: v for k, v in (filters or {}).items() if v and v.strip()}
    first = sites.where("site IS NOT NULL").groupBy("site").agg(F.min("seq").alias("seq"))
    own = sites.where("site IS NULL").unionByName(sites.join(first, ["site", "seq"], "left_semi").select(sites.columns))
    extra = registry.join(first.select("site"), "site", "left_anti")
    shape = lambda t, cls: t.select(F.lit(cls).alias("cls"), "id", "name", folded(F.col("district")).alias("district"), folded(F.col("city")).alias("city"), "lon", "lat")
    spots = shape(own, "site")
    if asked and districts is not None:
        lost = spots.where("district = ''").withColumn("point_id", F.col("id"))
        found = inside(lost.select("point_id", "lon", "lat"), districts.select(folded(F.col("key")).alias("d"), folded(F.col("parent")).alias("c"), "pos", "rings"), how="first").where("d IS NOT NULL")
        lost = lost.join(found.select("point_id", "d", "c"), "point_id").select("cls", "id", "name", F.col("d").alias("district"), F.col("c").alias("city"), "lon", "lat")
        spots = spots.where("district <> ''").unionByName(lost)
    rows = shape(outlets, "outlet").unionByName(spots).unionByName(shape(extra, "site")).unionByName(shape(pois, "poi")).where(on_map(F.col("lat"), F.col("lon")))
    both = hierarchy.select(folded(F.col("district")).alias("d"), folded(F.col("city")).alias("c"), *[F.col(k).alias(f"own_{k}") for k in ("mc", "branch", "area")], F.lit(True).alias("own"))
    any_city = both.where("c = ''").select("d", *[F.col(f"own_{k}").alias(f"any_{k}") for k in ("mc", "branch", "area")], F.lit(True).alias("any"))
    rows = rows.join(both, (F.col("district") == F.col("d")) & (F.col("city") == F.col("c")), "left").drop("d", "c")
    rows = rows.join(any_city, F.col("district") == F.col("d"), "left").drop("d")
    rows = rows.withColumns({k: F.when(F.col("own"), F.col(f"own_{k}")).otherwise(F.col(f"any_{k}")) for k in ("mc", "branch", "area")})
    rows = rows.withColumn("in_territory", F.coalesce("own", "any", F.lit(False))).where(chosen(asked))
    rows = rows.select("cls", "id", "name", "district", "city", "in_territory", "lon", "lat")
    return rows if most is None else thinned(rows, most, ["cls", "id"]).drop("place")


def coloured(features: DataFrame, field: str, pos: str = "pos") -> DataFrame:
    """A layer's own polygons with ``group`` and ``colour`` by a field, groups in the order in which they first come (JOIN-33)."""
    rows = features.withColumn("group", F.coalesce(F.nullif(F.trim(F.col(field).cast("string")), F.lit("")), F.lit("(no value)")))
    groups = numbered(rows.groupBy("group").agg(F.min(pos).alias("_first")), [F.col("_first"), F.col("group")], "_n")
    colour = hex_colour(golden_hue((F.col("_n") - 1).cast("double")))
    return rows.join(groups.select("group", (F.col("_n") - 1).alias("group_no"), colour.alias("colour")), "group")


def checks(outlets: DataFrame, villages: DataFrame, district: str, village: Sequence[str], rep: str, flag: Column) -> DataFrame:
    """A dashboard's figures (AGG-24) as rows of ``what`` and ``n``: the eight districts with most outlets, villages without
    any, flagged outlets, rows without a rep, and outlets a rep in tenths."""
    top = outlets.groupBy(F.coalesce(district, F.lit("-")).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(8)
    empty = villages.join(outlets.select(*village).distinct(), list(village), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    reps = outlets.groupBy(rep).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(flag, F.lit(False))).alias("f"))
    reps = reps.agg(F.sum("n").alias("outlets"), F.sum("f").alias("flagged"), F.sum(F.when(F.col(rep).isNull(), F.col("n")).otherwise(0)).alias("no_rep"), F.floor(F.sum("n") * 10.0 / F.greatest(F.count(rep), F.lit(1)) + 0.5).alias("mean_x10"))
    reps = reps.unpivot([], reps.columns, "what", "n").select("what", F.col("n").cast("long").alias("n"))
    return top.select(F.concat(F.lit("district: "), F.col("d").cast("string")).alias("what"), "n").union(empty.select(F.lit("villages without outlet"), "n")).union(reps)


def derived(rows: DataFrame, steps: Mapping[str, str], differ: tuple[str, str] | None = None) -> DataFrame:
    """How many rows each derived step has filled (AGG-34), and how many a pair of columns tells differently."""
    counts = {k: F.count_if(F.coalesce(F.col(c).cast("string") != "", F.lit(False))) for k, c in steps.items()}
    if differ:
        counts["differ"] = F.count_if(F.coalesce(F.col(differ[0]) != F.col(differ[1]), F.lit(False)))
    told = rows.agg(*[c.alias(k) for k, c in counts.items()])
    return told.unpivot([], told.columns, "step", "n").withColumn("done", F.col("n") > 0)


def operator_tally(points: DataFrame) -> DataFrame:
    """Service points by operator with the largest class, most first (AGG-35)."""
    return points.groupBy("operator").agg(F.max(F.coalesce("class", F.lit("operator"))).alias("class"), F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "operator")


def top_categories(places: DataFrame, most: int = 40) -> DataFrame:
    """The most frequent categories (AGG-35)."""
    return places.where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(most)
