"""A deterministic, sharded WARC writer, and its reader.

Records are ranged by id and digest. A histogram over prefixes of that key (a few cells a shard, the
only thing that passes the driver) is cut into shards of about equal payload bytes; a cell that
alone outweighs half a shard is cut again by longer prefixes, so that outlying, wide or repeated
ids change nothing. Each shard is sorted and written as gzip members, and a new file begins when
one has ``roll_bytes`` compressed bytes. The same input gives the same files byte for byte, however
Spark deals out the work: names come from shard and file numbers, headers and digests are made
anew, and dates are a parameter.

A file is written under a temporary name and renamed when it is whole; a task that is run again
writes the same bytes under the same name. What counts are the files in the manifest, a table that
Spark commits after all tasks have ended; what failed tasks left behind is then removed.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a
``response``; the others are ``revisit`` records that refer to it and carry no payload.

Defined results: a null payload is empty; a null url is written as a urn of the id; rows with a null
id come first and never are what others refer to unless all copies have null ids; of repeated rows
the first is the response, and rows with equal ids and payloads are in one shard. Ids are any 64-bit
integers. An empty table gives a manifest without files. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lean import lean, small_batches
from .storage import stored

#: Shards that are made at least, where keys allow it; their size at most.
LEAST_SHARDS = 128
SHARD_BYTES = 256 << 20

#: Bytes that are unpacked at a time; what follows a record in them is copied.
_PIECE = 1 << 16

_MANIFEST = "file string, records long, bytes long, sha256 string"
_RECORD = "file string, record_id string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, as tasks open it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _record_id(page_id: int | None, digest: str, repeat: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{repeat}')}>"


def _clean(url: str | None, page_id: int | None) -> str:
    return f"urn:page:{page_id}" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


class _File:
    """A WARC file that gets its name when it is whole."""

    def __init__(self, folder: str, name: str, date: str):
        self.store, root = _filesystem(folder)
        self.name, self.temporary, self.final = name, f"{root}/_{name}.{uuid.uuid4().hex[:8]}.tmp", f"{root}/{name}"
        self.store.create_dir(root, recursive=True)
        self.out, self.digest, self.bytes, self.records = self.store.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        info = b"software: terrafold\r\nformat: WARC File Format 1.1\r\n"
        self.add([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name, 0)), ("WARC-Filename", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)
        self.records = 0

    def add(self, fields: list[tuple[str, str]], block: bytes) -> None:
        member = _member(fields, block)
        self.out.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.store.move(self.temporary, self.final)
        return pa.RecordBatch.from_pylist([{"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.digest.hexdigest()}])


#: Characters of a key: a mark of null ids, the id's 64 bits and the digest, in hexadecimal.
_KEY_LENGTH = 1 + 16 + 64


def _key() -> Column:
    """Text that sorts as (page_id, digest) does."""
    bits = F.col("page_id").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), 63))
    return F.concat(F.when(F.col("page_id").isNull(), "0" * 17).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(bits), 16, "0"))), "digest")


def _shards(small: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What gives rows with ``page_id`` and ``digest`` their ``shard``, and the number of shards."""
    spark = small.sparkSession
    rows = small.select(_key().alias("key"), (F.col("payload_bytes") + 200).alias("n"), F.lit("").alias("cell"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(LEAST_SHARDS, total // SHARD_BYTES)
    cells, steps, heavy = {}, [], {"": 0}
    while heavy:
        # prefixes grow by so much that there are a few cells a shard
        more = max(1, int(math.log(4 * shards / len(heavy), 16)))
        ends = [(cell, min(_KEY_LENGTH, size + more)) for cell, size in heavy.items()]
        steps.append(spark.createDataFrame(ends, "own string, size int"))
        rows = _stepped(rows, steps[-1]).where("size IS NOT NULL").drop("size")
        found = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).toArrow().to_pylist()
        cells |= {r["cell"]: r["n"] for r in found}
        # of keys that begin alike, the next prefix goes beyond what they share
        heavy = {r["cell"]: len(os.path.commonprefix([r["low"], r["high"]])) for r in found if 2 * r["n"] * shards > total and r["low"] < r["high"]}
        for cell in heavy:
            del cells[cell]
    done, out = 0, []
    for cell in sorted(cells):
        out.append((cell, done * shards // total))
        done += cells[cell]
    found = spark.createDataFrame(out, "cell string, shard int")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("key", _key()).withColumn("cell", F.lit(""))
        for step in steps:
            rows = _stepped(rows, step).drop("size")
        return rows.join(F.broadcast(found), "cell").drop("cell", "key")

    return placed, shards


def _stepped(rows: DataFrame, step: DataFrame) -> DataFrame:
    """Rows of the cells in ``step`` in smaller cells."""
    rows = rows.join(F.broadcast(step), F.col("cell") == F.col("own"), "left").drop("own")
    return rows.withColumn("cell", F.when(F.col("size").isNotNull(), F.expr("substring(key, 1, size)")).otherwise(F.col("cell")))


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 100, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` as WARC files in ``folder``; returns the manifest, which is in ``folder``/manifest."""
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    small = stored(rows.select("page_id", "digest", "payload_bytes"), "digests")
    placed, shards = _shards(small)

    long = small.where(F.col("payload_bytes") >= least_bytes).select("page_id", "digest")
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = long.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    # what a row is comes just before it in the sort order, so that payloads are shuffled once
    told = revisits.select("page_id", "digest", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    both = told.union(rows.select("page_id", "digest", F.lit(1), F.lit(None).cast("long"), "url", "payload"))
    both = placed(both)
    both = both.repartition(shards, "shard") if shards > LEAST_SHARDS else both.repartition("shard")
    ordered = both.sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, shard, number, last, first, repeat = None, None, 0, None, None, 0
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in ("page_id", "digest", "kind", "first", "url", "shard")}
                key = (one["page_id"], one["digest"])
                if file is not None and (one["shard"] != shard or file.bytes >= roll_bytes):
                    yield file.close()
                    file = None
                if one["shard"] != shard:
                    shard, number, last = one["shard"], 0, None
                if key != last:
                    last, first, repeat, refers = key, one["first"], 0, one["kind"] == 0
                if one["kind"] == 0:
                    continue
                if file is None:
                    file, number = _File(folder, f"shard-{shard:06d}-{number:05d}.warc.gz", date), number + 1
                data = batch.column("payload")[row].as_buffer().to_pybytes()
                again = refers or (repeat > 0 and len(data) >= least_bytes)
                fields = [
                    ("WARC-Type", "revisit" if again else "response"),
                    ("WARC-Record-ID", _record_id(*key, repeat)),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _clean(one["url"], one["page_id"])),
                    ("WARC-Payload-Digest", f"sha256:{one['digest']}"),
                    ("X-Payload-Length", str(len(data))),
                    ("Content-Type", "application/http;msgtype=response"),
                ]
                if one["page_id"] is not None:
                    fields.append(("X-Page-ID", str(one["page_id"])))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                if again:
                    target = first if refers else one["page_id"]
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(target, one["digest"], 0))]
                    if target is not None:
                        fields.append(("X-Refers-To-Page-ID", str(target)))
                    file.add(fields, head)
                else:
                    block = head + data
                    fields.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
                    file.add(fields, block)
                repeat += 1
        if file is not None:
            yield file.close()

    ordered.select("page_id", "digest", "kind", "first", "url", "payload", "shard").mapInArrow(lean(work), _MANIFEST).write.parquet(f"{folder}/manifest")
    store, root = _filesystem(folder)
    for one in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if one.base_name.startswith("_") and one.base_name.endswith(".tmp"):
            store.delete_file(one.path)
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, read piece by piece."""
    unpacker, record = zlib.decompressobj(31), []
    for piece in data:
        while piece:
            record.append(unpacker.decompress(piece))
            piece = unpacker.unused_data
            if unpacker.eof:
                head, _, block = b"".join(record).partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                yield fields, block[: int(fields["Content-Length"])]
                unpacker, record = zlib.decompressobj(31), []
            elif not piece:
                break
    if record:
        raise ValueError("a WARC file ends within a record")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in ``folder``'s manifest. Payload digests of responses are computed anew, and
    a file or record that doesn't agree with its digest is an error."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    count, total = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    # names are few bytes, so tasks must be dealt out by what they stand for
    tasks = max(1, min(count, max(LEAST_SHARDS, (total or 0) // SHARD_BYTES)))
    files = manifest.select("file", "sha256").repartition(tasks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist()):
                store, root = _filesystem(folder)
                digest, out = hashlib.sha256(), []

                def pieces():
                    with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                        while piece := file.read(_PIECE):
                            digest.update(piece)
                            yield piece

                for fields, block in _records(pieces()):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != told or len(payload) != size:
                            raise ValueError(f"{name}: payload of {fields['WARC-Record-ID']} doesn't agree with its digest")
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                    out.append({"file": name, "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "page_id": number("X-Page-ID"), "target_uri": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": told, "refers_to": number("X-Refers-To-Page-ID")})
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if digest.hexdigest() != expected:
                    raise ValueError(f"{name} doesn't agree with the manifest")
                yield pa.RecordBatch.from_pylist(out, schema)

    text, whole = pa.string(), pa.int64()
    schema = pa.schema([("file", text), ("record_id", text), ("record_type", text), ("page_id", whole), ("target_uri", text), ("payload_bytes", whole), ("payload_digest", text), ("refers_to", whole)])
    return files.mapInArrow(lean(work), _RECORD)
