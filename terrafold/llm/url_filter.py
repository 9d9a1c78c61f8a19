"""URL filters: host and path rules first, gradient-boosted trees for the rest.

A rule names a host and a path prefix; it fits the host and all its subdomains, and the longest
fitting rule decides. Urls that no rule decides are judged by gradient-boosted trees over lexical
features: lengths, depth, digit ratio, character entropy, parameter counts, and the block rates
and numbers of labelled urls with the same suffixes, the last label of the host and the last two.

Suffix statistics cover all labelled urls; the trees are fitted on at most ``MOST_ROWS`` of them, those
with the smallest hashes. For fitting, a url's statistics leave out the fold (of ``FOLDS``) that its
host belongs to: neither its own label nor any of its host is among them, so that the trees learn to
trust a suffix as far as it tells something about hosts not seen before.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; ties
between rules of equal length go to the first in text order; equal rows get equal verdicts; a suffix
without labels has the rate 0.5 and the count 0; without labelled urls of both kinds everything
undecided is allowed. Only the named columns are read; ``carry`` columns are handed on whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Labelled urls that the trees are fitted on at most.
MOST_ROWS = 20_000
#: Suffixes whose statistics are sent to every task at most; more are joined by a shuffle.
MOST_BROADCAST = 500_000

#: Parts that hosts are dealt into for out-of-fold statistics.
FOLDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CHARACTERS = _LOWER + "0123456789-._/?=&%:#"
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "top_rate", "top_count", "suffix_rate", "suffix_count")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host and path, such as ``example.com/en/``; verdict is block or allow."""

    pattern: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        own = (host == name) | host.endswith("." + name)
        return own & path.startswith(slash + rest)


@dataclass(frozen=True)
class Model:
    """Fitted trees, or None where there was nothing to learn, and of each suffix and fold (-1: all) the
    numbers of labelled and of blocked urls."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame


def _parts(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _count(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(of), F.lit("")))


def _lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the suffix of rows with ``url``, ``host`` and ``path``."""
    url = F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER)
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    shares = [_count(url, c) / length for c in _CHARACTERS]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
    query = F.substring_index(F.substring_index(url, "#", 1), "?", -1)
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.size(F.array_remove(F.split("path", "/"), "")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / length).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.when(F.contains(url, F.lit("?")), _count(query, "&") + 1).otherwise(0).cast("double").alias("parameters"),
        _count(F.col("host"), "-").cast("double").alias("hyphens"),
        F.substring_index("host", ".", -1).alias("top"),
        F.substring_index("host", ".", -2).alias("suffix"),
    )


def _split(frame: DataFrame, url: str, *more: Column) -> DataFrame:
    host, path = _parts(F.col(url))
    return frame.select(F.col(url).alias("url"), host.alias("host"), path.alias("path"), *more)


def _with_suffixes(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Block rates and counts of each row's suffixes, without the part of them that its ``fold`` names (-1: none)."""
    few = suffixes.count() <= MOST_BROADCAST
    for name in ("top", "suffix"):
        whole, part = (suffixes.where(w).select(F.col("suffix").alias(name), *keys, F.col("n").alias("n" + tag), F.col("blocked").alias("blocked" + tag)) for w, keys, tag in (("fold = -1", (), "_all"), ("fold >= 0", ("fold",), "_own")))
        for side, on in ((whole, [name]), (part, [name, "fold"])):
            rows = rows.join(F.broadcast(side) if few else side, on, "left")
        left = {c: F.coalesce(F.col(c + "_all"), F.lit(0.0)) - F.coalesce(F.col(c + "_own"), F.lit(0.0)) for c in ("n", "blocked")}
        rows = rows.withColumns({name + "_rate": (left["blocked"] + 1) / (left["n"] + 2), name + "_count": F.log1p(left["n"])}).drop("n_all", "n_own", "blocked_all", "blocked_own")
    return rows


def fit(labelled: DataFrame, url: str = "url", label: str = "label", most_rows: int = MOST_ROWS, trees: int = 12, depth: int = 4) -> Model:
    """Trees fitted on labelled urls; label 1 is block, 0 is allow."""
    rows = _lexical(_split(labelled, url, F.col(label).cast("double").alias("label")).where("label IS NOT NULL"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    each = rows.select(F.explode(F.array_distinct(F.array("top", "suffix"))).alias("suffix"), "fold", "label")
    each = each.groupBy("suffix", "fold").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("blocked"))
    whole = each.groupBy("suffix").agg(F.lit(-1).alias("fold"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    suffixes = stored(each.unionByName(whole), "suffixes")
    if rows.agg(F.min("label") == F.max("label")).first()[0] is not False:
        return Model(None, suffixes)
    sample = rows.orderBy(F.xxhash64("url"), "url").limit(most_rows)
    # of both kinds there are some, however rare one is
    rare = rows.where("label = 1").orderBy(F.xxhash64("url"), "url").limit(most_rows // 4).union(rows.where("label = 0").orderBy(F.xxhash64("url"), "url").limit(most_rows // 4))
    known = _with_suffixes(sample.union(rare), suffixes)
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known).select("features", "label").repartition(4).cache()
    found = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(made)
    made.unpersist()
    return Model(found, suffixes)


def judged(pages: DataFrame, rules: Sequence[Rule], model: Model, url: str = "url", carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """For each page ``carried`` (a struct of the ``carry`` columns), ``host``, ``path``, ``rule`` and ``verdict``."""
    rows = _split(pages, url, F.struct(*[F.col(c) for c in carry]).alias("carried"))
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    fits = [(r, r.fits(F.col("host"), F.col("path"))) for r in ordered]
    rows = rows.withColumn("rule", F.coalesce(F.lit(None).cast("string"), *[F.when(c, F.lit(r.pattern)) for r, c in fits]))
    rows = rows.withColumn("verdict", F.coalesce(F.lit(None).cast("string"), *[F.when(c, F.lit(r.verdict)) for r, c in fits]))
    if model.trees is None:
        return rows.select("carried", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_suffixes(_lexical(rows).withColumn("fold", F.lit(-1)), model.suffixes))
    rows = model.trees.transform(rows)
    own = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return rows.select("carried", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"))
