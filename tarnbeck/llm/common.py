"""Shared ground of the training-data operators: inputs, scratch tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`.
WORD_SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one NumPy step works on at a time; a longer text is a step of its own.
BLOCK_BYTES = 2_000_000
#: Files that rows are numbered by without a copy; a number has 23 bits for the file and 40 for the row.
FILES = 1000
#: Written tables after which the driver's garbage is collected.
COLLECT = 3
_written = itertools.count(1)
_FORGET = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns (also ones that clash with an operator's own) fall away."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: object):
    """The session's setting, for what is run inside alone."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Written tables that cut lineage, in the shared folder of spark.checkpoint.dir.

    Any executor can read them again, so a job outlives lost executors. Without the setting a local session (tests) uses
    a temporary folder; a cluster's session is refused, as its machines share no such folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
            base = os.path.join(tempfile.gettempdir(), "tarnbeck-scratch")
        self.base = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table. Its shuffles have no reader after that: Spark is told to forget them with the write.

        Spark removes what else a job has left (broadcasts, tasks' code) when the driver collects its garbage. A query
        of hundreds of small jobs doesn't fill the driver's heap with live objects, but lets it grow to its limit; so
        after every COLLECT tables it is collected, which takes some tenths of a second.
        """
        path = f"{self.base}/{name}-{uuid.uuid4().hex}"
        with setting(self.spark, _FORGET, "true"):
            df.write.parquet(path)
        if next(_written) % COLLECT == 0:
            self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def large(column: pa.Array) -> pa.Array:
    """As large_string, without nulls."""
    return column.cast(pa.large_string()).fill_null("")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, row after the last, bytes, offsets from 0) of runs of texts of about `limit` bytes."""
    arr = large(column)
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def slices(batches, limit: int = BLOCK_BYTES, column: str = "text"):
    """Arrow batches cut so that each holds about `limit` bytes of text at most, or one row. No text is copied."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def numbered(docs: DataFrame, *columns: str, name: str = "rid") -> DataFrame:
    """The columns (all of them if none is named) and a row number that every reading of the frame gives again.

    For a plain scan of at most FILES files it is made of the file and the row's place in it. Anything else is written
    once with its row numbers, which are then read as data. So no number depends on how a reading is split into tasks.
    """
    own = [F.col(f"`{c}`") for c in columns or docs.columns]
    plan = docs._jdf.queryExecution().analyzed()
    if plan.children().isEmpty() and any(a.name() == "_metadata" for a in _items(plan.metadataOutput())):
        path = F.col("_metadata.file_path")
        files = sorted(r[0] for r in docs.select(path).distinct().limit(FILES + 1).collect())
        if len(files) <= FILES:
            at = F.array_position(F.array(*map(F.lit, files)), path) if files else F.lit(0)
            number = F.when(at > 0, at).otherwise(F.raise_error(F.lit("file of no known number"))).cast("long")
            return docs.select(*own, (F.shiftleft(number, 40) + F.col("_metadata.row_index")).alias(name))
    return Scratch(docs.sparkSession).keep(docs.select(*own, F.monotonically_increasing_id().alias(name)), "input")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]
