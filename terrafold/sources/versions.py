"""Tables with versions, whose upserts write only what they touch (SNK-2, 3, 15, 19).

Rows lie in buckets by a hash of their keys, a file for each bucket and change. A version is a list of files, one for each
bucket that has rows; an upsert or a deletion reads the buckets of its keys, writes these anew and makes a list with their new
files and the old ones of all others. Older versions stay whole, so who reads one isn't disturbed. A version is there once its
folder has its name, which the file system gives to one writer only; who loses the race gets an error and can try again.

Keys and their types are those of the first version. The rows of a change must have one row a key at most; of several the
greatest is taken. Null keys are keys. Lists have ``buckets`` rows at most, and only they pass the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "keys array<string>, buckets int, bucket int, file string"


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _listed(spark: SparkSession, path: str, pattern: str) -> list[str]:
    fs, place = _fs(spark, f"{path}/{pattern}")
    return sorted(x.getPath().toString() for x in fs.globStatus(place) or [])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions, from 1."""
    return [int(x.rpartition("=")[2]) for x in _listed(spark, path, "versions/v=*")]


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[int, list]:
    known = versions(spark, path)
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise ValueError(f"no version {version} in {path}")
    return version, spark.read.schema(_LIST).parquet(f"{path}/versions/v={version:09d}").collect()


def _publish(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    made = f"{path}/versions/.new-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, _LIST).coalesce(1).write.parquet(made)
    fs, source = _fs(spark, made)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/v={version:09d}")
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"version {version} has been written by another; try again")


def _bucketed(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> dict[int, str]:
    """Write rows with their ``_bucket``, a file each; bucket to file."""
    spark, folder = rows.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    rows.repartition("_bucket").sortWithinPartitions("_bucket", *keys).write.option("maxRecordsPerFile", 0).partitionBy("_bucket").parquet(folder)
    return {int(f.split("_bucket=")[1].split("/")[0]): f for f in _listed(spark, folder, "_bucket=*/*.parquet")}


def _one_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*rows.columns) if rest else rows.distinct()


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> int:
    """Make a table of rows; its first version is 1."""
    spark = rows.sparkSession
    if versions(spark, path):
        raise ValueError(f"{path} has versions already")
    files = _write(_bucketed(_one_each(rows, keys), keys, buckets), path, keys, buckets)
    _publish(spark, path, 1, [(list(keys), buckets, b, f) for b, f in files.items()] or [(list(keys), buckets, None, None)])
    return 1


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A version's rows, those of the last one if none is named."""
    files = [r.file for r in _manifest(spark, path, version)[1] if r.file is not None]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _changed(change: DataFrame, path: str, merge) -> int:
    spark = change.sparkSession
    version, known = _manifest(spark, path, None)
    keys, buckets = known[0].keys, known[0].buckets
    change = _bucketed(_one_each(change, keys), keys, buckets)
    touched = {r._bucket for r in change.select("_bucket").distinct().collect()}
    old = [r.file for r in known if r.bucket in touched]
    files = _write(merge(old, change, keys, buckets), path, keys, buckets) if touched else {}
    kept = {r.bucket: r.file for r in known if r.bucket is not None and r.bucket not in touched} | files
    _publish(spark, path, version + 1, [(keys, buckets, b, f) for b, f in sorted(kept.items())] or [(keys, buckets, None, None)])
    return version + 1


def _without(spark: SparkSession, old: list[str], schema: str, change: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    rows = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
    gone = change.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return _bucketed(rows.join(gone, same, "left_anti"), keys, buckets)


def upsert(rows: DataFrame, path: str) -> int:
    """Put rows in place of those with their keys, or beside the others; the new version's number.

    Rows have the table's columns. Buckets without any of their keys are not read and not written.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return _changed(rows, path, lambda old, change, keys, n: _without(rows.sparkSession, old, schema, change, keys, n).unionByName(change))


def delete(keys: DataFrame, path: str, schema: str) -> int:
    """Remove the rows with these keys; the new version's number. ``schema`` is the table's."""
    return _changed(keys, path, lambda old, change, names, n: _without(keys.sparkSession, old, schema, change, names, n))
