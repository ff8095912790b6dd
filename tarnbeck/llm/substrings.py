"""Removal of repeated substrings by a sampled, distributed suffix array.

A byte goes if a `length`-byte string over it also starts anywhere else. Sorting the suffix of every byte would move
`length` times the corpus, so suffixes are sampled without loss: every `length`-byte string has an anchor, the
leftmost smallest hash among its GRAM-byte strings; equal strings have equal anchors at equal places.

1. Anchor suffixes are range-partitioned by sampled splitters on their leading bytes, sorted by multikey quicksort and
   compared with their neighbours, also across bucket boundaries. An anchor met once has no repeated string.
   Anchors whose whole stretch of text is met twice are settled: all of it repeats.
2. For the other anchors, and one settled anchor of each kind beside them, the suffixes of their strings are sorted and compared in the same way, which settles each string exactly. Digests of 128 bits stand for the bytes.
3. Each candidate text is joined with its repeated stretches and cut.

Null texts are empty; matches never cross documents; two rows with the same text are two documents that repeat each
other, whatever their ids. Texts shorter than `length` stay. Extra columns fall away.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch, blocks, large, numbered, partitions
from tarnbeck.llm.grams import VALUES, mix, powers, prefix
from tarnbeck.llm.sorting import repeated

#: Bytes of an anchor; fewer make fewer anchors to sort in step 1, more make fewer strings to sort in step 2.
GRAM = 240
_SECOND = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bits of a place below a hash: the same for texts of any size, as equal strings have to choose equal anchors.
PLACE_BITS = np.uint64(36)
_LEAD = np.array([1 << (56 - 8 * i) for i in range(8)], np.uint64)


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima within blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


class Anchors:
    """Anchors of a run of texts: place, first and last start of the strings that they stand for (all in `buf`)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
        n = len(buf)
        self.at = self.low = self.high = self.doc = np.zeros(0, np.int64)
        self.sums = None
        if n < length:
            return
        self.sums = prefix(buf)
        p, q = powers(n)
        m = n - gram + 1
        grams = mix((self.sums[gram:] - self.sums[:m]) * q[:m])
        self.grams = grams
        bits = PLACE_BITS
        low = window_minima((grams >> bits << bits) | np.arange(m, dtype=np.uint64), length - gram + 1)
        at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.arange(len(at))
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(at)]
        inside = starts + length <= offs[1:][doc]
        starts, at, doc = starts[inside], at[inside], doc[inside]
        if not len(at):
            return
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        self.at, self.low, self.high, self.doc = at[first], starts[first], starts[last], doc[first]


def lead(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight leading bytes as a number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out |= buf[at + i].astype(np.uint64) * _LEAD[i]
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def _anchor_rows(length: int, gram: int):
    names = ["lead", "gram", "stretch", "rid", "place"]

    def emit(batches):
        for b in batches:
            rid = b.column("rid").to_numpy()
            for i, j, buf, offs in blocks(b.column("text")):
                a = Anchors(buf, offs, length, gram)
                if len(a.at):
                    raw, rel, span = memoryview(np.ascontiguousarray(buf)), a.at - a.low, a.high - a.low
                    digest = np.array([xxhash.xxh3_64_intdigest(raw[x:y], int(s)) for x, y, s in zip(a.low.tolist(), (a.high + length).tolist(), (rel * 1024 + span).tolist())], np.uint64)
                    place = (a.at - offs[a.doc]) << 24 | rel << 12 | span
                    cols = [lead(buf, a.at), a.grams[a.at].view(np.int64), digest.view(np.int64), rid[i + a.doc], place]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names)

    return emit, "lead long, gram long, stretch long, rid long, place long"


def _string_rows(length: int, gram: int):
    names = ["lead", "d1", "d2", "rid", "start"]

    def emit(batches):
        for b in batches:
            rid, open_ = b.column("rid").to_numpy(), b.column("open")
            for i, j, buf, offs in blocks(b.column("text")):
                a = Anchors(buf, offs, length, gram)
                if not len(a.at):
                    continue
                left = []
                for k in range(i, j):
                    left.append((np.array(open_[k].as_py() or [], np.int64) >> 24) + offs[k - i])
                left = np.concatenate(left)
                second = prefix(buf, _SECOND)
                for k in np.array_split(np.flatnonzero(np.isin(a.at, left)), max(1, len(a.at) // 2000)):
                    count = a.high[k] - a.low[k] + 1
                    if not len(k):
                        continue
                    start = np.repeat(a.low[k] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    doc = np.repeat(a.doc[k], count)
                    if len(start):
                        q = powers(len(buf))[1][start]
                        d1, d2 = mix((a.sums[start + length] - a.sums[start]) * q), mix((second[start + length] - second[start]) * q)
                        cols = [lead(buf, start), d1.view(np.int64), d2.view(np.int64), rid[i + doc], start - offs[doc]]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names)

    return emit, "lead long, d1 long, d2 long, rid long, start long"


def _cut(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def cut(batches):
        for b in batches:
            text, out = large(b.column("text")), [[] for _ in names]
            for k in range(b.num_rows):
                raw = np.frombuffer(text[k].as_buffer(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                whole = np.array(b.column("settled")[k].as_py() or [], np.int64)
                start = (whole >> 24) - (whole >> 12 & 4095)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + (whole & 4095) + length, -1)
                single = np.array(b.column("starts")[k].as_py() or [], np.int64)
                np.add.at(edge, single, 1)
                np.add.at(edge, single + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])
                for x, v in zip(out, (b.column("doc_id")[k].as_py(), len(raw), int(np.count_nonzero(gone)), int(spans), hashlib.sha256(raw[~gone].tobytes()).hexdigest())):
                    x.append(v)
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(),) * 4 + (pa.string(),))], names)

    return cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text); length < 4096."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), 4 * partitions(spark)
    gram = min(gram, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = numbered(docs, "doc_id", "text").select("rid", F.col("doc_id").cast("long"), text.alias("text"))
    emit, schema = _anchor_rows(length, gram)
    anchors = scratch.keep(rows.select("rid", "text").mapInArrow(emit, schema), "anchors")
    met = repeated(anchors, [["lead", "gram"], ["lead", "gram", "stretch"]], ["rid", "place"], scratch, parts, ["met", "settled"])
    per_text = met.groupBy("rid").agg(F.collect_list(F.when(F.col("settled"), F.col("place"))).alias("settled"), F.collect_list(F.when(~F.col("settled") | F.col("stands"), F.col("place"))).alias("open"))
    found = scratch.keep(rows.join(per_text, "rid"), "candidates")
    scratch.drop(anchors, met)
    emit, schema = _string_rows(length, gram)
    strings = found.where(F.size("open") > 0).select("rid", "text", "open").mapInArrow(emit, schema)
    twice = repeated(strings, [["lead", "d1", "d2"]], ["rid", "start"], scratch, parts, ["twice"])
    starts = twice.groupBy("rid").agg(F.collect_list("start").alias("starts"))
    cut, schema = _cut(length)
    got = found.join(starts, "rid", "left").select("doc_id", "text", "settled", "starts").mapInArrow(cut, schema)
    # Texts without a candidate: what is told of them is made before the join, so that their bytes don't move.
    whole = rows.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return got.unionByName(whole.join(found.select("rid"), "rid", "left_anti").drop("rid"))
