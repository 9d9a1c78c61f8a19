"""Sessions for tests and benches, and the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session; shuffle partitions follow the CPUs, adaptive execution does the rest."""
    n = 8 if cpus == "*" else int(cpus)
    settings = {"spark.sql.shuffle.partitions": n, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("terrafold").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return with_checkpoints(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and stored tables, which the driver and all executors see.

    The cluster names it by ``spark.checkpoint.dir`` or ``setCheckpointDir``. Only a local session without either, as in
    tests, gets one of its own; on a cluster every executor would write to its own disk, so there it is an error.
    The setting itself can't be changed once Spark runs.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return f"/tmp/checkpoints/{context.applicationId}"


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Let ``checkpoint()`` write to ``checkpoint_dir``."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder.

    For loops with joins: a checkpoint hands the conditions of the plan that made it on to the next one, so that plans of
    a loop take longer and longer to optimize; a table has none.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/terrafold/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
