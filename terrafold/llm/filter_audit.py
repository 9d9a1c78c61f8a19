"""What filters do to a corpus in every order they could be applied in.

Whether a document fails a filter doesn't depend on the others, so all that orders can change is a
function of its mask, the set of filters that it fails. Documents are counted by part and mask, and
labelled ones too; the histograms of all parts are stacked as rows of an integer matrix. What becomes
of a mask at a step of an order are columns of four more, 2 ** n rows by n! * n columns (32 by 600 for
five filters): kept, removed here, redundant, and failing this filter only. Their product has the
counts of all parts, orders and steps; exact, as it is made of whole numbers.

Scale: texts are read once, where they lie, and leave it as ids, digests and masks. Copies are told by
their SHA-256 and the smallest id of each; this id is joined back by (digest, id), so that a group of
copies with a third of all rows is no key of its own. A part is at most 2 ** n rows before its
histogram is put together.

Defined results: a null text is empty, a null part the empty string; an empty text fails A and has no
words to repeat; null ids are copies of nothing, and nothing is a copy of them; rows with equal ids are
not copies of each other; of several labels of one id any counts; labels without a document don't
count; an empty table has no parts. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lean import lean, small_batches
from .storage import stored

#: The filters in the order of their bits in a mask; the last one is told by comparison with other documents.
FILTERS = "ABCDE"
#: Most filters that orders are listed for: 8 have 322,560 steps a part.
MOST_FILTERS = 8
#: Rows of the result that are made at a time.
ROWS = 40_000

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def outcomes(n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of ``n`` filters, and the matrices of masks by (order, step)."""
    orders = list(permutations(range(n)))
    bits = 1 << np.array(orders, np.int64)
    earlier = (np.cumsum(bits, axis=1) - bits).reshape(-1)
    here = bits.reshape(-1)
    masks = np.arange(1 << n, dtype=np.int64)[:, None]
    fails, gone = (masks & here) > 0, (masks & earlier) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == here}
    return orders, {k: v.astype(np.int64) for k, v in found.items()}


def text_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def bits(w: Column) -> Column:
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        n = F.size(w).cast("long")
        failing = [n < 50, 100 * F.size(F.array_distinct(w)).cast("long") < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)), F.lit(0))

    # an array of one, so that the words are made once
    return F.element_at(F.transform(F.array(words), bits), 1)


def masks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Documents by ``doc_id``, ``part`` and the ``mask`` of the filters A to E that they fail, and how many (``n``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), text_mask(whole).alias("mask"))
    rows = stored(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.join(first, ["digest", "doc_id"], "left")
    return rows.select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask"), "n")


def histograms(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Documents of each ``part`` and ``mask``: all (``n``), those of good quality and toxic ones."""
    told = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    told = told.agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return masks.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def audited(histograms: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """A row for each ``part``, ``filter_order`` and ``step`` (from 1), with its counts, by a product of matrices.

    ``filters`` names the bits of ``mask`` in their order; a mask has no others.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"orders of 1 to {MOST_FILTERS} filters are listed")
    small_batches(histograms.sparkSession)
    stacked = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, by = outcomes(n)
        names = pa.array(["".join(filters[k] for k in o) for o in orders])
        which = np.array(orders).reshape(-1)
        per = max(1, ROWS // len(which))
        for batch in batches:
            for at in range(0, batch.num_rows, per):
                slice_ = batch.slice(at, per)
                lists = slice_.column("counts")
                owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                flat = lists.flatten()
                rows = np.zeros((3, len(lists), 1 << n), np.int64)
                for k, c in enumerate(("n", "good", "toxic")):
                    rows[k, owner, flat.field("mask").to_numpy()] = flat.field(c).to_numpy()
                out = {k: rows[0] @ by[k] for k in ("kept", "removed", "redundant", "unique_fails")}
                out["good_lost"], out["toxic_lost"] = rows[1] @ by["removed"], rows[2] @ by["removed"]
                own = np.stack([out["removed"][:, which == k].sum(axis=1) for k in range(n)], axis=1)
                out["shapley"] = own[:, which]
                steps, parts = len(which), len(lists)
                columns = {
                    "part": slice_.column("part").take(pa.array(np.repeat(np.arange(parts), steps))),
                    "filter_order": names.take(pa.array(np.tile(np.repeat(np.arange(len(orders)), n), parts))),
                    "step": pa.array(np.tile(np.arange(steps) % n + 1, parts), pa.int32()),
                } | {k: pa.array(out[k].reshape(-1)) for k in _COUNTS}
                yield pa.RecordBatch.from_pydict(columns)

    return stacked.mapInArrow(lean(work), "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in _COUNTS))
