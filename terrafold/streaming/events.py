"""Incremental forms of the upsert and of counts, over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.sources.sinks import upserted


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; state of windows that are ``late`` past is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def upsert_stream(events: DataFrame, table: str, keys: list[str], checkpoint: str):
    """Keep a table of the last row of each key. Each batch is merged by ``upserted``, with the batch's number as
    run and time, so that a batch that is repeated gives the same table. Versions alternate between two folders."""

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = batch.select(*[c for c in batch.columns])
        if number == 0:
            stamp = F.lit("batch-0")
            plain = [c for c in new.columns if c not in keys]
            rows = new.groupBy(*keys).agg(F.max(F.struct(*plain)).alias("_row")).select(*keys, "_row.*")
            rows = rows.select("*", stamp.alias("first_seen"), stamp.alias("last_seen"), F.lit(0).cast("long").alias("run_id"))
        else:
            rows = upserted(spark.read.parquet(f"{table}/v{(number - 1) % 2}"), new, keys, f"batch-{number}", number)
        rows.write.mode("overwrite").parquet(f"{table}/v{number % 2}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
