"""Packing by powers of two: sequences without padding that never cross documents.

A document's token ids, with an end id, are cut into pieces of the longest length and then into the
powers of two that its rest is the sum of, longest first. Each piece is a sequence by itself, so
nothing is padded and no sequence sees two documents. Sequences of equal length are a bucket: they have
consecutive numbers, longest bucket first, in an order of hashes, so that neighbours come from all over
the corpus. ``write_buckets`` lays them down by length, as a trainer with batches of one length reads them.

Scale: texts are read once and become pieces where they lie; a piece is a few numbers (or its ids, if
they are carried) from then on. Numbers come from one shuffle by ranges of (length, hash), in which a
document's pieces are spread, and from the counts of the ranges; these, a row for each partition, are all
that is broadcast. The ranges are checkpointed, so that a lost executor changes no number.

Ids are those of the ``tokenizers`` library by its file, special tokens added by none, their strings in a
text taken as such. They are made by ``tiktoken`` over the same vocabulary, three times as fast; what its
pattern engine refuses (runs of a million spaces) goes to ``tokenizers`` itself. Both agree wherever every
token of the vocabulary is encoded as itself, which the tests hold for the public file.

Defined results: a null or empty text is the end id alone, one sequence of length 1; null and repeated ids
are documents of their own; equal rows have equal pieces with numbers of their own; an empty table has no
sequences. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.session import with_checkpoints

from .lean import lean, small_batches
from .storage import stored
from .words import sliced

#: Ids of the pieces that are made at a time, if they are carried.
SLICE_IDS = 1 << 20
#: Rows of a partition that a number has room for.
_ROW_BITS = 33


def lengths(n: int, longest: int) -> list[int]:
    """The pieces of ``n`` ids: as many of the longest length as go in, then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _bytes_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that can be seen, and else as one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """Token ids of texts by a byte-level BPE file of ``tokenizers``, given as its JSON."""

    def __init__(self, told: str, pattern: str):
        import tiktoken

        made, byte = json.loads(told), _bytes_of()
        special = {x["content"]: x["id"] for x in made["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): k for token, k in made["model"]["vocab"].items() if token not in special}
        self.told, self.other = told, None
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            return self.by_tokenizers(text)

    def by_tokenizers(self, text: str) -> np.ndarray:
        if self.other is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.other = Tokenizer.from_str(self.told)
        return np.array(self.other.encode(text, add_special_tokens=False).ids, "<u4")


_made: dict[str, Tokens] = {}


def _tokens(shared, pattern: str) -> Tokens:
    """One for each Python worker."""
    key = f"{pattern}\n{zlib.crc32(shared.value.encode())}"
    if key not in _made:
        _made.clear()
        _made[key] = Tokens(shared.value, pattern)
    return _made[key]


def pieces(documents: DataFrame, path: str, pattern: str, longest: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", carry_ids: bool = False) -> DataFrame:
    """The pieces of each document: ``doc_id``, ``start``, ``length``, ``ids_crc32`` of their little-endian ids,
    ``doc_tokens`` and, with ``carry_ids``, the ``ids``. ``longest`` is a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * carry_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared, pattern)

        def told(part: pa.RecordBatch, rows: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            owner, *numbers = zip(*rows)
            columns = [part.column("doc_id").take(pa.array(owner)), *(pa.array(c, pa.int64()) for c in numbers)]
            if carry_ids:
                bounds = np.concatenate([[0], np.cumsum(numbers[1])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).view("<i4"))))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in sliced(batch):
                rows, ids, held = [], [], 0
                for k, text_ in enumerate(part.column("text")):
                    all_ids, start = np.append(tokens.ids(text_.as_py() or ""), np.uint32(end_id)).astype("<u4"), 0
                    for n in lengths(len(all_ids), longest):
                        own = all_ids[start : start + n]
                        rows.append((k, start, n, zlib.crc32(own), len(all_ids)))
                        if carry_ids:
                            ids.append(own)
                            if (held := held + n) >= SLICE_IDS:
                                yield told(part, rows, ids)
                                rows, ids, held = [], [], 0
                        start += n
                if rows:
                    yield told(part, rows, ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(work), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * carry_ids)


def packed(documents: DataFrame, path: str, pattern: str, longest: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", carry_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` (gapless from 0, by length and then by hash) and their
    ``offset`` in it, which is 0."""
    with_checkpoints(documents.sparkSession)
    # stored, as ranges are drawn from a sample first, which would make all pieces once more
    rows = stored(pieces(documents, path, pattern, longest, end_id, doc_id, text, carry_ids), "pieces")
    order = [F.col("length").desc(), F.xxhash64("doc_id", "start", "ids_crc32"), F.col("doc_id"), F.col("start")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    place = F.monotonically_increasing_id()
    rows = rows.withColumn("range", F.shiftright(place, _ROW_BITS)).withColumn("row", place.bitwiseAND((1 << _ROW_BITS) - 1))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    number = (F.col("before") + F.col("row")).alias("sequence_id")
    kept = [c for c in rows.columns if c not in ("range", "row")]
    return rows.join(F.broadcast(counts), "range").select(*kept, number, F.lit(0).cast("long").alias("offset"))


def write_buckets(sequences: DataFrame, folder: str) -> None:
    """Write what ``packed`` gives with ``carry_ids``: a folder ``length=n`` for each bucket, its files by number."""
    sequences.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id").write.partitionBy("length").parquet(folder)
