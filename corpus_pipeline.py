"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, and its decisions take effect: documents that break
quality rules go, one document of each group of near duplicates stays, passages that an earlier
document has are cut out, documents that hold benchmark passages go, and the rest is encoded.
All stages but the last return the columns of ``documents``, and further ones that come with it; an empty
table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.bpe import encoded
from terrafold.llm.decontaminate import contamination
from terrafold.llm.ngram_join import similar_groups
from terrafold.llm.quality_rules import judged
from terrafold.llm.storage import stored
from terrafold.llm.substring_dedup import deduplicated

#: Ids that are sent to every task at most (of 16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000

#: The last stage's ids have no SQL form.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all quality rules. Null and empty texts break the first one, so they go; ids don't matter
    (null or repeated ones stay as they are)."""
    return judged(docs, carry=docs.columns).where("kept").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays, that with the smallest id (null ids last). Rows with equal ids (or none) and
    texts are one document; texts without words are near copies of nothing."""
    groups = stored(similar_groups(docs, chosen=True), "groups")
    key = F.xxhash64("text")
    gone = groups.where("NOT stays").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (key == gone["_row"]), "left_anti")
    twice = stored(groups.where("stays").groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")), "repeated")
    if twice.isEmpty():
        return rows
    same = rows["doc_id"].eqNullSafe(twice["_id"]) & (key == twice["_row"])
    return rows.join(twice, same, "left_anti").union(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; documents of which nothing is left go, others stay as they are,
    null and empty texts among them. ``n_chars`` follows the text, if there is such a column."""
    rows = deduplicated(docs, carry=docs.columns).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("carried.text"))
    new = F.col("carried").withField("text", text)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(new.alias("carried")).select("carried.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null and empty texts hold none, ids don't matter."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark, carry=docs.columns).where(F.size("spans") == 0).select("carried.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of the ids and of the bytes they decode to; a null text has no ids."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = encoded(docs, ranks, pattern, decode=True)
    ids_sha256 = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
