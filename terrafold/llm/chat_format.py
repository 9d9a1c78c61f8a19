"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each time with more turns. The turns of a conversation
get gapless numbers and a rolling hash of all turns up to each; a conversation whose last hash is
that of an earlier turn of another is a snapshot of it. Anti-joins keep those that are a prefix of
no longer one; of equal ones the smallest id stays. The turns of those kept are then rendered, a
row each, so that no conversation is gathered in one place; in order of ``turn_no`` they are its text.

Rolling hashes are two exclusive-or sums of 64-bit hashes that hold the turn's number, so they are
made of blocks: first within ``BLOCK`` consecutive turn values, then over blocks. A conversation
with a third of all rows is many blocks.

Defined results: turns are ordered by turn (nulls first), then role and text; equal turn values are
turns of their own; rows with a null id are one conversation; a null role is rendered as ``unknown``
and a null text as empty, but both differ from these when conversations are compared. Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

#: Turn values of a block.
BLOCK = 256


def rolling(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with ``turn_no`` (from 1) and ``h1``, ``h2``, the hashes of all turns up to it."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)).cast("long"))

    def before(totals: DataFrame, *sums) -> DataFrame:
        """Sums over the earlier blocks of the conversation."""
        earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("conv_id", "block", *[F.coalesce(f(c).over(earlier), F.lit(0).cast("long")).alias(f"before_{c}") for f, c in sums])

    def with_earlier(rows: DataFrame, earlier: DataFrame) -> DataFrame:
        same = rows["conv_id"].eqNullSafe(earlier["conv_id"]) & rows["block"].eqNullSafe(earlier["block"])
        return rows.join(earlier, same).drop(earlier["conv_id"]).drop(earlier["block"])

    counts = before(rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")), (F.sum, "n"))
    rows = with_earlier(rows, counts).withColumn("turn_no", F.col("before_n") + F.col("place"))
    told = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    nulls = [F.col(c).isNull() for c in ("role", "text")]
    rows = rows.withColumn("a", F.xxhash64("turn_no", *told, *nulls)).withColumn("b", F.xxhash64(F.lit(1), *nulls, *reversed(told), "turn_no"))
    totals = before(rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")), (F.bit_xor, "a"), (F.bit_xor, "b"))
    up_to = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("h1", F.bit_xor("a").over(up_to)).withColumn("h2", F.bit_xor("b").over(up_to))
    rows = with_earlier(rows, totals)
    return rows.select("conv_id", "turn_no", "role", "text", F.col("h1").bitwiseXOR(F.col("before_a")).alias("h1"), F.col("h2").bitwiseXOR(F.col("before_b")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """Ids of the conversations (rows of ``rolling``) that are a prefix of no other."""
    keys = ["turn_no", "h1", "h2"]
    ends = turns.groupBy("conv_id").agg(F.max("turn_no").alias("turn_no"), F.max_by("h1", "turn_no").alias("h1"), F.max_by("h2", "turn_no").alias("h2"))
    last = ends.select(F.col("conv_id").alias("c"), F.col("turn_no").alias("n"))
    prefixes = turns.join(last, turns["conv_id"].eqNullSafe(last["c"]) & (turns["turn_no"] == last["n"]), "left_anti").select(*keys).distinct()
    # equal conversations first, so that no key is many rows in the next join
    return ends.groupBy(*keys).agg(F.min("conv_id").alias("conv_id")).join(prefixes, keys, "left_anti").select("conv_id")


def rendered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: tuple[str, str, str] = ("<|im_start|>", "\n", "<|im_end|>\n")) -> DataFrame:
    """The turns of maximal conversations: ``conv_id``, ``turn_no``, ``role`` and ``rendered``."""
    turns = stored(rolling(conversations, conv_id, turn, role, text), "turns")
    kept = maximal(turns).withColumnRenamed("conv_id", "kept")
    start, middle, end = template
    out = F.concat(F.lit(start), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end))
    return turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).select("conv_id", "turn_no", "role", out.alias("rendered"))
