"""Range partitioning by sampled splitters, local multikey quicksort, and comparison across bucket boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.llm.common import Scratch

_SMALL = 1 << 12


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows whose keys are the columns' words, most significant first (three-way split on a word's pivot)."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k == len(columns):
            continue
        rows = order[lo:hi]
        if hi - lo <= _SMALL:
            order[lo:hi] = rows[np.lexsort([c[rows] for c in columns[:k:-1]] + [columns[k][rows]])]
            continue
        word = columns[k][rows]
        pivot = np.partition(word[:: max(1, len(word) // 1024)], min(512, (len(word) - 1) // max(1, len(word) // 1024) // 2))[min(512, (len(word) - 1) // max(1, len(word) // 1024) // 2)]
        less, same = word < pivot, word == pivot
        parts = [rows[less], rows[same], rows[~(less | same)]]
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), lo + len(parts[0]) + len(parts[1])
        todo += [(lo, a, k), (a, b, k + 1), (b, hi, k)]
    return order


def repeated(rows: DataFrame, keys: list[list[str]], ties: list[str], scratch: Scratch, parts: int, flags: list[str]) -> DataFrame:
    """rows (long columns only) with a boolean column per entry of `keys`: whether another row has the same key.

    Each key is a list of columns, a prefix of the next one. The splitters also tell rows with equal keys apart (by
    `ties`), so a key that a third of all rows share spreads over many buckets. A bucket flags what repeats within it;
    only its first and last row can repeat elsewhere alone, and these (two per bucket) are compared by the driver.
    Rows without any flag are dropped. `stands` marks, in each bucket, one row of every full key, where rows with the
    first key and another full key are in the bucket or may be in the next one: the pick that others are held against.
    """
    names = rows.columns
    at = [[names.index(c) for c in key] for key in keys]
    order = [names.index(c) for c in keys[-1]]
    schema = T.StructType(rows.schema.fields + [T.StructField(f, T.BooleanType()) for f in [*flags, "stands"]] + [T.StructField("_bucket", T.IntegerType()), T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())])

    def mark(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(len(names))]
        del got
        by = multikey_quicksort([cols[i] for i in order])
        cols = [c[by] for c in cols]
        n, found = len(by), []
        for key in at:
            same = np.ones(n - 1, bool)
            for i in key:
                same &= cols[i][1:] == cols[i][:-1]
            flag = np.zeros(n, bool)
            flag[1:] |= same
            flag[:-1] |= same
            found.append(flag)
        change = [np.ones(n, bool) for _ in at]
        for new, key in zip(change, at):
            new[1:] = False
            for i in key:
                new[1:] |= cols[i][1:] != cols[i][:-1]
        group = np.cumsum(change[0]) - 1
        kinds = np.bincount(group, weights=change[-1])
        kinds[[0, -1]] = 2
        stands = change[-1] & (kinds[group] > 1)
        edge = np.zeros(n, bool)
        edge[[0, -1]] = True
        keep = np.flatnonzero(found[0] | edge)
        first, last = keep == 0, keep == n - 1
        bucket = np.full(len(keep), TaskContext.get().partitionId(), np.int32)
        out = [pa.array(c[keep]) for c in cols] + [pa.array(f[keep]) for f in [*found, stands]] + [pa.array(bucket), pa.array(first), pa.array(last)]
        whole = pa.RecordBatch.from_arrays(out, schema.names)
        for i in range(0, whole.num_rows, 100_000):
            yield whole.slice(i, 100_000)

    kept = scratch.keep(rows.repartitionByRange(parts, *[F.col(c) for c in [*keys[-1], *ties]]).mapInArrow(mark, schema), "sorted")
    ends = kept.where("_first or _last").collect()  # two rows a bucket at most
    ends.sort(key=lambda r: (r["_bucket"], not r["_first"]))
    fixes = []
    for a, b in zip(ends, ends[1:]):
        if a["_bucket"] != b["_bucket"]:
            for key, flag in zip(keys, flags):
                if all(a[c] == b[c] for c in key):
                    fixes += [(a["_bucket"], False, flag), (b["_bucket"], True, flag)]
    out = kept
    for flag in flags:
        firsts = [x[0] for x in fixes if x[2] == flag and x[1]]
        lasts = [x[0] for x in fixes if x[2] == flag and not x[1]]
        out = out.withColumn(flag, F.col(flag) | (F.col("_first") & F.col("_bucket").isin(firsts)) | (F.col("_last") & F.col("_bucket").isin(lasts)))
    out = out.where(F.col(flags[0])).drop("_bucket", "_first", "_last")
    out._scratch_path = kept._scratch_path
    return out
