"""Where the operators of this subpackage keep tables between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from terrafold.session import checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one that the driver and all executors see."""
    return f"{checkpoint_dir(spark)}/terrafold/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a
    lost executor costs nothing that was already computed. ``clear`` removes it."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored; to be called when results are written, as they are lazy until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
