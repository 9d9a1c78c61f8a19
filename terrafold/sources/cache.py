"""Tables that are made once for a stamp, and layers of one table (SRC-2, SRC-32, SNK-1, SNK-12)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def cached(spark: SparkSession, folder: str, stamp: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """What ``build`` gives, from ``folder`` if it was made there for the same stamp, such as the time of an import.

    A table counts once Spark has committed it; ``refresh`` makes it anew. Tables of other stamps stay, for readers that
    still use them.
    """
    path = f"{folder.rstrip('/')}/{hashlib.sha1(stamp.encode()).hexdigest()[:16]}"
    if refresh or not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def layer(spark: SparkSession, folder: str, key: str, by: str = "layer_key") -> DataFrame:
    """One layer of a table that is partitioned by layer; the others' files are not read."""
    return spark.read.parquet(folder).where(F.col(by) == key)
