"""Reproducible sharding by a permutation of row numbers.

Rows get gapless global numbers, and a Feistel network with cycle walking permutes these: the
place p of a row is a bijection of its number, its shard is p modulo the shard count and its slot
p divided by it. Shard and slot of any number can be computed without the data, and row counts of
shards differ by one at most (law ``rows``).

Numbers do not depend on how the table lies in files or partitions: rows are counted by (id, size,
checksum), these keys are hashed to buckets, and numbers run through the buckets in key order.
Equal keys are aggregated first and spread again in runs, so that a key with a third of all rows
is no task's burden. Only the bucket totals (``BUCKETS`` rows at most) pass through the driver.

Defined results: a null text has size 8 and the checksum of the empty text; null ids are a key like
others; repeated rows get different slots; an empty table gives an empty result. Only the named
columns are read. Columns to ``carry`` move along with their rows and may be of any type that can be
grouped; rows of one key that differ in them are numbered in their order, so a row's place needs no
join back. ``write_shards`` lays rows down by shard and slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

#: Buckets of keys; each is numbered by itself.
BUCKETS = 4096
#: Repeats of one key that are spread as a run.
RUN = 4096
#: Fixed values of the round function: odd multipliers below 2 ** 31, and increments.
ROUNDS = ((1103515245, 12345), (1664525, 1013904223), (214013, 2531011), (69069, 362437), (1566083941, 40503), (134775813, 1))


def _round(half: Column, multiplier: Column, increment: Column) -> Column:
    """A hash of up to 31 bits of a value below 2 ** 31, in whole-number arithmetic that cannot overflow."""
    x = F.pmod(half * multiplier + increment, F.lit(2**31))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * 1274126177, F.lit(2**31))
    return x.bitwiseXOR(F.shiftright(x, 13))


def feistel(number: Column, width: int, seed: int) -> Column:
    """A bijection of the numbers below 2 ** (2 * width), width up to 31."""
    mask = (1 << width) - 1
    rounds = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit((a + seed * 7919 + k) % 2**31).cast("long").alias("a")) for k, (m, a) in enumerate(ROUNDS)])
    sides = F.struct(F.shiftright(number, width).alias("l"), number.bitwiseAND(mask).alias("r"))
    swap = lambda s, c: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_round(s["r"], c["m"], c["a"]).bitwiseAND(mask)).alias("r"))
    return F.aggregate(rounds, sides, swap, lambda s: F.shiftleft(s["l"], width).bitwiseOR(s["r"]))


#: Walks after which a number that is still outside raises an error.
_WALKS = 512


def permuted(number: Column, count: int, seed: int = 0) -> Column:
    """A bijection of the numbers below ``count``.

    The network permutes a power of four below 4 * count; a result of ``count`` or more is permuted again,
    until it lies below. A quarter of the numbers do at least, so that 512 walks do not fail (0.75 ** 512).
    """
    width = max(1, ((max(count, 1) - 1).bit_length() + 1) // 2)
    walk = lambda x, _: F.when(x < count, x).otherwise(feistel(x, width, seed))
    some = F.aggregate(F.sequence(F.lit(1), F.lit(10)), feistel(number, width, seed), walk)
    rest = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(_WALKS)), x, walk)
    error = F.raise_error(F.lit("cycle walking did not end")).cast("long")
    # arrays of one, so that each step's value is computed once and then tested
    out = F.transform(F.array(some), lambda x: F.when(x < count, x).otherwise(rest(x)))
    return F.element_at(F.transform(out, lambda x: F.when(x < count, x).otherwise(error)), 1)


def row_numbers(rows: DataFrame, keys: list[str], carry: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """``rows`` aggregated by ``keys`` and ``carry`` and spread again, with a gapless ``number`` from 0; and their count.

    The keys alone choose the bucket, so a key's rows have the same numbers whatever is carried.
    """
    first, keys = keys, [*keys, *carry]
    spark = rows.sparkSession
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.pmod(F.xxhash64(*first), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    counted = stored(counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "numbered")
    totals = sorted((r.bucket, r.n) for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for bucket, n in totals:
        starts.append((bucket, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "bucket int, start long"))
    runs = counted.join(offsets, "bucket").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / RUN) - 1)))
    runs = runs.repartition(F.expr(f"CASE WHEN n > {RUN} THEN xxhash64(bucket, before, run) ELSE xxhash64(bucket, before) END"))
    one = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))
    return runs.select(*keys, "start", "before", one.alias("repeat")).select(*keys, (F.col("start") + F.col("before") + F.col("repeat")).alias("number")), total


def sharded(documents: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Each document's ``doc_id``, ``size`` (UTF-8 bytes and 8), ``text_crc32``, ``number``, ``shard`` and ``slot``,
    and with ``carry`` a struct ``carried`` of these columns."""
    carried = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    rows = documents.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), *carried)
    names = ["carried"] if carry else []
    rows, count = row_numbers(rows, ["doc_id", "size", "text_crc32"], names)
    rows = rows.withColumn("place", permuted(F.col("number"), count, seed))
    return rows.select("doc_id", "size", "text_crc32", "number", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), *names)


def write_shards(rows: DataFrame, folder: str, shards: int) -> None:
    """Write what ``sharded`` gives with ``carry``: a folder ``shard=k`` with one file for each shard, its rows by slot."""
    placed = rows.select("shard", "slot", "carried.*").repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(folder)
