"""Who serves an outlet, from columns that files fill in differently (PRJ-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import not_blank

#: Fixed value: texts in the id column that are no ids.
_NO_ID = r"(?i)^(rayon|area|n/?a|none|vacant|tbd|-+)\b.*|^\W*$"


def identity(own: Column, pairing: Column, brand_code: Column, rayon: Column, label: Column) -> Column:
    """The id column unless it holds none, else the pairing code without the brand, else the brand's code, else
    rayon and label."""
    told = not_blank(own)
    told = F.when(~told.rlike(_NO_ID), told)
    pair = F.regexp_replace(not_blank(pairing), r"(?i)[\s_-]*(im3|3id)$", "")
    return F.coalesce(told, pair, not_blank(brand_code), F.concat_ws(" · ", not_blank(rayon), not_blank(label)))


def demoted(rows: DataFrame, key: str, code: str, most: float = 0.8) -> DataFrame:
    """Rows keyed by code instead if the keys are nearly as many as the rows, and so name outlets, not reps."""
    sizes = rows.agg((F.count_distinct(key) / F.count(F.lit(1))).alias("ratio")).first()
    return rows.withColumn(key, F.col(code)) if (sizes.ratio or 0) >= most else rows
