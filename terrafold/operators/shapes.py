"""Rings of polygons made simpler (GEO-3, GEO-14, GEO-15, JOIN-28), as Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from terrafold.functions.geo import let

RING = "array<array<double>>"


def _far(points: np.ndarray, a: int, b: int) -> tuple[float, int]:
    """The point between two of a line that is farthest from their segment, and its squared distance."""
    p, q, mid = points[a], points[b], points[a + 1 : b]
    d = q - p
    length = float(d @ d)
    t = np.clip(((mid - p) @ d) / length, 0, 1) if length else np.zeros(len(mid))
    off = mid - (p + t[:, None] * d)
    each = (off * off).sum(axis=1)
    k = int(each.argmax())
    return float(each[k]), a + 1 + k


def simplified(ring: Column, tolerance: float, digits: int = 5) -> Column:
    """Douglas-Peucker, then rounded, without repeats (GEO-14)."""

    @pandas_udf(RING)
    def work(rings: pd.Series) -> pd.Series:
        def one(ring):
            points = np.array([list(p) for p in ring], float).reshape(-1, 2)
            keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
            while todo and len(points) > 3:
                a, b = todo.pop()
                if b - a > 1:
                    d, k = _far(points, a, b)
                    if d > tolerance * tolerance:
                        keep.add(k)
                        todo += [(a, k), (k, b)]
            kept = points[sorted(keep)] if len(points) > 3 else points
            out = [[round(x, digits), round(y, digits)] for x, y in kept.tolist()]
            return [p for k, p in enumerate(out) if k == 0 or p != out[k - 1]]

        return rings.map(lambda r: None if r is None else one(r))

    return work(ring)


def thinned_ring(ring: Column, least: float) -> Column:
    """Points at least a distance from the last one kept; the ends stay (GEO-15)."""
    step = lambda kept, p: F.when((F.size(kept) == 0) | (F.pow(p[0] - F.element_at(kept, -1)[0], 2) + F.pow(p[1] - F.element_at(kept, -1)[1], 2) >= least * least), F.concat(kept, F.array(p))).otherwise(kept)
    inner = F.aggregate(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.array().cast(RING), step)
    return F.concat(inner, F.slice(ring, -1, 1))


def inner_point(rings: Column) -> Column:
    """A point inside a polygon: middle of the widest span at its middle latitude (GEO-3)."""
    middle = lambda ys: (F.array_min(ys) + F.array_max(ys)) / 2

    def crossings(rings, lat):
        def of(ring):
            following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
            hit = lambda p, q: F.when((p[1] > lat) != (q[1] > lat), (q[0] - p[0]) * (lat - p[1]) / (q[1] - p[1]) + p[0])
            return F.filter(F.zip_with(ring, following, hit), lambda x: x.isNotNull())

        return F.array_sort(F.flatten(F.transform(rings, of)))

    def widest(xs):
        span = lambda k: F.struct((F.get(xs, 2 * k - 1) - F.get(xs, 2 * k - 2)).alias("w"), ((F.get(xs, 2 * k - 1) + F.get(xs, 2 * k - 2)) / 2).alias("lon"))
        return F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(xs) / 2), F.lit(1)).cast("int")), span))["lon"]

    found = lambda rings, lat: F.named_struct(F.lit("lon"), let(crossings(rings, lat), widest), F.lit("lat"), lat)
    return let(rings, lambda r: let(let(F.transform(F.element_at(r, 1), lambda p: p[1]), middle), lambda lat: found(r, lat)))


def merged_parts(features: DataFrame, *keys: str) -> DataFrame:
    """Features that share a key as one, with all their polygons (JOIN-28)."""
    return features.groupBy(*keys).agg(F.flatten(F.sort_array(F.collect_list("polys"))).alias("polys"), F.count(F.lit(1)).alias("parts"))
