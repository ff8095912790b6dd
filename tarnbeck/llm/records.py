"""Token ids as length-delimited binary records, with an offset index beside them for shuffled reads.

Layout of a folder:

* `data/part-<task>-...-c<file>`: shards of about SHARD_BYTES, numbered by task and file. A shard is MAGIC, one byte for
  the width of an id (2 or 4), records, and one line feed as its end mark. A record is the length of its payload (8
  bytes), the masked checksum of those 8 bytes (4), the payload, the masked checksum of the payload (4). A payload is one
  byte (1: there is a doc_id), the doc_id (8 bytes) and the ids. All numbers are little-endian. A checksum is CRC-32,
  masked by a rotation and an added constant, so that a checksum of data which holds checksums stays sound.
* `index`: a Parquet table of shard, offset, bytes, doc_id, n_tokens, start. It is made from the shards' frames, so it
  can't disagree with them, and can be made again at any time.

Spark writes and commits the shards (each one value of its text writer), so that they may lie in any store that Spark can
write to, and a task that is run again leaves no part of a shard behind. Documents are dealt by ranges of (doc_id, row)
and encoded in the task that writes them; a doc_id of many rows is spread over tasks as any others are. Reading checks
every checksum, the end mark and the lengths; a broken shard ends the job with its name and the offset.

Cases: null texts count as empty: a record of the end token alone. Null doc_ids come first. Rows of one doc_id keep the
order of the table. An empty table gives a folder without shards and an empty index. Texts are encoded whole, however
long; a document larger than SHARD_BYTES has a shard of its own. Extra columns fall away.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch, numbered, setting, slices
from tarnbeck.llm.word_ids import block_tokens

END_ID = 2
SHARD_BYTES = 4_000_000
#: Bytes of text that are encoded at a time.
BLOCK_BYTES = 1_000_000
#: Rows that Spark hands to an encoding worker at once: both sides hold a batch and its copy in Arrow's memory.
BATCH_ROWS = 1000
MAGIC = b"TBREC1"
_HEAD = len(MAGIC) + 1
_FRAME = 16
#: Before the ids: whether there is a doc_id, and the doc_id.
_ID = "<Bq"
_ID_BYTES = struct.calcsize(_ID)
#: Fixed value of masked checksums in record files.
MASK = 0xA282EAD8
#: Shards whose sums one task adds up.
GROUP = 4096


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(_ID, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


class Broken(ValueError):
    """A shard that isn't what was written."""


class Shard:
    """The records of one shard's bytes."""

    def __init__(self, data: bytes | memoryview, name: object):
        self.data, self.name = memoryview(data), name
        if len(data) and (len(data) <= _HEAD or bytes(self.data[: len(MAGIC)]) != MAGIC or self.data[len(MAGIC)] not in (2, 4) or self.data[-1] != 10):
            raise Broken(f"shard {name}: no such file format, or its end is missing")
        self.width = self.data[len(MAGIC)] if len(data) else 4

    def payload(self, at: int, whole: bool = True) -> memoryview:
        """Of the record at an offset, its checksum held against it if `whole`."""
        end = len(self.data) - 1
        if not _HEAD <= at <= end - _FRAME:
            raise Broken(f"shard {self.name}, offset {at}: a frame would pass the end")
        length, check = struct.unpack_from("<QI", self.data, at)
        if check != masked(self.data[at : at + 8]) or length < _ID_BYTES or at + _FRAME + length > end:
            raise Broken(f"shard {self.name}, offset {at}: wrong length")
        own = self.data[at + 12 : at + 12 + length]
        if whole and struct.unpack_from("<I", self.data, at + 12 + length)[0] != masked(own):
            raise Broken(f"shard {self.name}, offset {at}: the payload isn't what was written")
        return own

    def record(self, own: memoryview) -> tuple[int | None, np.ndarray]:
        known, doc = struct.unpack_from(_ID, own)
        return doc if known else None, np.frombuffer(own[_ID_BYTES :], f"<u{self.width}").astype("<u4")

    def frames(self, whole: bool = True):
        """(offset, payload) of every record."""
        at = _HEAD
        while at < len(self.data) - 1:
            own = self.payload(at, whole)
            yield at, own
            at += len(own) + _FRAME


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """The shards of docs (doc_id, text), in ascending doc_id order."""

    def frames(batches):
        machine = block_tokens(tokenizer_path)
        width = 2 if max(machine.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        head, end = MAGIC + bytes([width]), np.array([end_id], "<u4")
        parts, size = [head], len(head)
        for b in slices(batches, BLOCK_BYTES):
            ids, counts = machine.block([t or "" for t in b.column("text").to_pylist()])
            cuts = np.cumsum(counts)
            for doc, last, n in zip(b.column("doc_id").to_pylist(), cuts.tolist(), counts.tolist()):
                own = frame(payload(doc, np.concatenate((ids[last - n : last], end)), width))
                if len(parts) > 1 and size + len(own) > shard_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["shard"])
                    parts, size = [head], len(head)
                parts.append(own)
                size += len(own)
        if len(parts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["shard"])

    rows = numbered(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "rid")
    order = [F.col("doc_id").asc_nulls_first(), F.col("rid")]
    shards = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(frames, "shard binary")
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS):
        shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/data")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """shard (number by task and file), content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    number = lambda group: F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)[^/]*$", group).cast("long")
    return files.select((F.shiftleft(number(1), 20) + number(2)).alias("shard"), "content")


def _starts(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """shard, base (ids of all shards before it), from shard, n. Sums of GROUP shards each are added up one after another."""
    group = F.floor(F.col("place") / GROUP)
    placed = Scratch(spark).keep(sizes.repartitionByRange("shard").sortWithinPartitions("shard").withColumn("place", F.monotonically_increasing_id()), "shard-sizes")
    placed = placed.withColumn("group", group)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = placed.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("all"))
    inner = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, "group").select("shard", (F.col("all") + F.col("inner")).alias("base"))


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the folder's shards, written and read again."""

    def walk(batches):
        for b in batches:
            for number, content in zip(b.column("shard").to_pylist(), b.column("content")):
                shard, rows, start = Shard(content.as_buffer(), number), [], 0
                for at, own in shard.frames(whole=False):
                    known, doc = struct.unpack_from(_ID, own)
                    n = (len(own) - _ID_BYTES) // shard.width
                    rows.append((number, at, len(own) + _FRAME, doc if known else None, n, start))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["shard", "offset", "bytes", "doc_id", "n_tokens", "inner"])

    scratch = Scratch(spark)
    frames = scratch.keep(_shards(spark, path).mapInArrow(walk, "shard long, offset long, bytes long, doc_id long, n_tokens long, inner long"), "frames")
    starts = _starts(spark, frames.groupBy("shard").agg(F.sum("n_tokens").alias("n")))
    frames.join(starts, "shard").select("shard", "offset", "bytes", "doc_id", "n_tokens", (F.col("base") + F.col("inner")).alias("start")).write.parquet(f"{path}/index")
    scratch.drop(frames)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard long, offset long, bytes long, doc_id long, n_tokens long, start long").parquet(f"{path}/index")


def write_records(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards and index of docs (doc_id, text) to a folder that is new; gives the index."""
    write_shards(docs, tokenizer_path, path, end_id, shard_bytes)
    return write_index(docs.sparkSession, path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, offset, n_tokens, ids (binary, unsigned 32-bit) of every record, each checked, shard by shard."""

    def read(batches):
        for b in batches:
            for number, content in zip(b.column("shard").to_pylist(), b.column("content")):
                shard = Shard(content.as_buffer(), number)
                yield _rows(shard, shard.frames())

    return _shards(spark, path).mapInArrow(read, _READ)


_READ = "doc_id long, shard long, offset long, n_tokens long, ids binary"


def _rows(shard: Shard, frames) -> pa.RecordBatch:
    rows = [(*shard.record(own), at) for at, own in frames]
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([shard.name] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "offset", "n_tokens", "ids"])


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records at the wanted places (shard, offset) of the index, each shard cut at its offsets alone."""

    def cut(batches):
        for b in batches:
            for number, content, places in zip(b.column("shard").to_pylist(), b.column("content"), b.column("places").to_pylist()):
                shard = Shard(content.as_buffer(), number)
                yield _rows(shard, ((at, shard.payload(at)) for at in places))

    places = wanted.groupBy("shard").agg(F.collect_list("offset").alias("places"))  # as many as a shard has records
    return _shards(spark, path).join(places, "shard").mapInArrow(cut, _READ)


def read_shuffled(spark: SparkSession, path: str, seed: int, wanted: DataFrame | None = None) -> DataFrame:
    """The records (all, or those wanted of the index) in an order that the seed fixes."""
    index = read_index(spark, path) if wanted is None else wanted
    return read_at(spark, path, index).orderBy(F.xxhash64(F.lit(seed), "shard", "offset"), "shard", "offset")


def record_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files that are written for it."""
    spark = docs.sparkSession
    path = f"{Scratch(spark).base}/records-{uuid.uuid4().hex}"
    bases = write_records(docs, tokenizer_path, path).groupBy("shard").agg(F.min("start").alias("base"))
    first = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    own = read_records(spark, path).select("doc_id", "shard", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    inner = F.coalesce(F.sum("n_tokens").over(first), F.lit(0))
    return own.withColumn("inner", inner).join(bases, "shard").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
