"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds a count per hundred of another, such as symbols per hundred words. All counts
come from one pass over each row: words, their length, symbols, marks, stop words, lines, and the
words in three-word windows that occur twice in the text. Repeated windows are found by sorting
hashes with their positions packed in their lowest bits (an array of longs); only those that have
an equal neighbour are compared as text.

Defined results: a null text counts as empty; texts of under 50 words fail the base rules, so empty
ones do; a rule with nothing to count per (no words, no lines) isn't broken. Only the named columns
are read; ``carry`` columns are handed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``count`` per hundred of ``per`` must lie between ``least`` and ``most``."""

    name: str
    count: str
    per: str
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        count, per = F.col(self.count) * 100, F.col(self.per)
        out = F.lit(False)
        if self.least is not None:
            out = out | (count < per * self.least)
        if self.most is not None:
            out = out | (count > per * self.most)
        return out


#: Stop words of four languages, the words that ordinary prose of any length repeats most.
STOP_WORDS = (
    "a and be for have in is of that the this to was with "
    "auf das der des die ein eine für ist mit und von zu den "
    "au dans de des du elle en est et il la le les que qui un une "
    "con del el en es la las lo los no para por que se un una y"
).split()

#: The rules beyond the base: mean word length, symbols, exclamation and question marks, repeated lines, stop words.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("marks", "n_marks", "n_words", most=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=1),
)

#: The base rules.
BASE = (Rule("repeated_words", "n_repeat_words", "n_words", most=50),)
LEAST_WORDS = 50

_SPACE = r"[\x20\x09-\x0D]+"
_LINE = r"[^\x20\x09-\x0D]"


def counted(documents: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, in a struct ``carried``, and every count that rules can name."""
    one_text = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.struct(*[F.col(c) for c in carry]).alias("carried"), one_text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(_LINE))
    rows = rows.select(
        "carried",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
    )
    rows = rows.select(
        "carried",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_marks",
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _with_repeat_words(rows).drop("words")


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words in three-word windows that start at two places or more."""
    # the lowest bits hold a position, the others the hash
    rows = rows.withColumn("bits", F.length(F.bin("n_words")))
    packed = F.transform(F.slice("words", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")), lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)), F.col("bits")).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("packed", F.sort_array(packed))
    hash_of = lambda x: F.call_function("shiftright", x, F.col("bits"))
    alike = lambda x, k: (hash_of(x) == hash_of(F.get("packed", k + 1))) | (hash_of(x) == hash_of(F.get("packed", k - 1)))
    position = lambda x: (x - F.call_function("shiftleft", hash_of(x), F.col("bits"))).cast("int")
    rows = rows.withColumn("alike", F.transform(F.filter("packed", alike), position))
    window = lambda p: F.struct(F.array_join(F.slice("words", p + 1, 3), " ").alias("w"), p.alias("p"))
    rows = rows.withColumn("windows", F.array_sort(F.transform("alike", window)))
    equal = lambda x, k: (x["w"] == F.get("windows", k + 1)["w"]) | (x["w"] == F.get("windows", k - 1)["w"])
    covered = F.flatten(F.transform(F.filter("windows", equal), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    # filters on the counts stay above this projection, as one of its columns isn't deterministic; pushed
    # down, they would put the arrays above in place of each use of them
    fence = F.spark_partition_id().alias("fence")
    return rows.select("*", F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"), fence).drop("bits", "packed", "alike", "windows")


def judged(documents: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, least_words: int = LEAST_WORDS, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``counted`` with ``base_failed``, ``broken`` (names of the broken rules) and ``kept``."""
    rows = counted(documents, text, carry)
    failed = F.col("n_words") < least_words
    for rule in base:
        failed = failed | rule.broken()
    names = F.array_compact(F.array(*[F.when(rule.broken(), F.lit(rule.name)) for rule in rules]))
    rows = rows.withColumn("base_failed", failed).withColumn("broken", names)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0) & (F.col("fence") >= 0)).drop("fence")
