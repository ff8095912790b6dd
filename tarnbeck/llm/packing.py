"""Packing of tokenized documents into sequences by a swap-based local search.

A sequence holds `capacity` tokens, so only the lengths 1 to capacity - 1 matter (a full piece is a sequence of its
own) and their histogram has at most capacity - 1 rows, whatever the corpus. The search works on that histogram:
equal bins form one group with a multiplicity. It starts from best fit over falling lengths and then moves
documents, exchanges one for one and two for one between underfull bins while squared fill rises, so that the
emptiest bins run dry. The driver holds the groups only (a few for each length); documents then take the slots of
their length by a rank that is counted in the cluster.

Null texts count as empty: a document of its end token alone. Repeated rows are packed each. Any doc_id may be null.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch, only, partitions, slices
from tarnbeck.llm.word_ids import BlockTokens

END_ID = 1
#: Bytes of text that are encoded at a time.
BLOCK_BYTES = 1_000_000
_tokens: dict[str, BlockTokens] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def cut(batches):
        if tokenizer_path not in _tokens:
            _tokens[tokenizer_path] = BlockTokens(tokenizer_path)
        machine = _tokens[tokenizer_path]
        for b in slices(batches, BLOCK_BYTES):
            rows = defaultdict(list)
            ids, counts = machine.block([t or "" for t in b.column("text").to_pylist()])
            ids = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4", copy=False)
            ends = np.cumsum(counts + 1).tolist()
            for doc, first, last in zip(b.column("doc_id").to_pylist(), [0, *ends], ends):
                for k, at in enumerate(range(first, last, capacity)):
                    part = ids[at : min(at + capacity, last)]
                    for name, value in (("doc_id", doc), ("piece", k), ("start", at - first), ("length", len(part)), ("ids_crc32", zlib.crc32(part))):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Groups of equal bins: content as ((length, how many), ...) with falling lengths -> number of bins."""

    def __init__(self, capacity: int):
        self.capacity, self.groups = capacity, defaultdict(int)

    @staticmethod
    def fill(content: tuple) -> int:
        return sum(n * k for n, k in content)

    @staticmethod
    def change(content: tuple, minus: tuple[int, ...] = (), plus: tuple[int, ...] = ()) -> tuple:
        own = dict(content)
        for n in minus:
            own[n] -= 1
        for n in plus:
            own[n] = own.get(n, 0) + 1
        return tuple(sorted(((n, k) for n, k in own.items() if k), reverse=True))

    def start(self, histogram: dict[int, int]) -> None:
        """Best fit over falling lengths, for all documents of a length at once."""
        room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
        for n in sorted(histogram, reverse=True):
            left = histogram[n]
            for r in sorted(r for r in room if r >= n):
                for content, bins in list(room[r].items()):
                    if not left:
                        break
                    fits = r // n
                    full = min(bins, left // fits)
                    uses = [(full, fits)] + ([(1, left - full * fits)] if full < bins and left - full * fits else [])
                    for many, k in uses:
                        if many:
                            room[r][content] -= many
                            room[r - n * k][(*content, (n, k))] += many
                            left -= many * k
                    if not room[r][content]:
                        del room[r][content]
                if not room[r]:
                    del room[r]
                if not left:
                    break
            fits = self.capacity // n
            if left // fits:
                room[self.capacity - n * fits][((n, fits),)] += left // fits
            if left % fits:
                room[self.capacity - n * (left % fits)][((n, left % fits),)] += 1
        for own in room.values():
            for content, bins in own.items():
                if bins:
                    self.groups[content] += bins

    def least(self) -> int:
        return -(-sum(self.fill(c) * m for c, m in self.groups.items()) // self.capacity)

    def count(self) -> int:
        return sum(self.groups.values())

    def _step(self, low: tuple, high: tuple) -> tuple[tuple, tuple] | None:
        """The change between a bin and one at least as full that raises squared fill the most, or None.

        What the fuller bin gains, the emptier one loses: a gain g raises squared fill by 2g(high - low) + 2g*g.
        """
        room = self.capacity - self.fill(high)
        a, b = [n for n, _ in low], [n for n, _ in high]
        best, found = 0, None
        for x in a:
            if best < x <= room:
                best, found = x, ((x,), ())
        have = set(a)
        for y in b:
            for x in a:
                if best < x - y <= room:
                    best, found = x - y, ((x,), (y,))
            # two from the emptier bin for one of the fuller, from both ends of its lengths
            i, k = 0, len(a) - 1
            while i <= k:
                gain = a[i] + a[k] - y
                if gain > room:
                    i += 1
                    continue
                if best < gain and (i != k or low[i][1] > 1):
                    best, found = gain, ((a[i], a[k]), (y,))
                k -= 1
        return found

    def search(self) -> None:
        """Until no bin is superfluous or nothing changes, drain the emptiest bins into other underfull ones.

        Squared fill rises at each change, so it ends. A change depends on the two contents alone: a group that found
        none is tried again only with groups that were added to since.
        """
        bins, least, clock = self.count(), self.least(), 1
        born: dict[tuple, int] = defaultdict(int)
        tried: dict[tuple, int] = {}
        while bins > least:
            under = sorted((f, c) for c in self.groups if (f := self.fill(c)) < self.capacity)
            changed = False
            for at, (filled, low) in enumerate(under):
                since, begun = tried.get(low, -1), clock
                for _, high in reversed(under[next(i for i in range(at, -1, -1) if not i or under[i - 1][0] < filled) :]):
                    if born[high] <= since or low not in self.groups or high not in self.groups or low == high and self.groups[low] < 2:
                        continue
                    if step := self._step(low, high):
                        many = self.groups[low] // 2 if low == high else min(self.groups[low], self.groups[high])
                        out, back = step
                        for content in (low, high):
                            self.groups[content] -= many
                            if not self.groups[content]:
                                del self.groups[content]
                        for content in (self.change(low, out, back), self.change(high, back, out)):
                            if content:
                                self.groups[content] += many
                                born[content] = clock = clock + 1
                            else:
                                bins -= many
                        changed = True
                if changed:
                    break
                tried[low] = begun
            if not changed:
                return


def slots(groups: dict[tuple, int]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, documents per bin, first bin, offset), by first rank."""
    rank: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple]] = defaultdict(list)
    bin_ = 0
    for content, bins in sorted(groups.items(), reverse=True):
        offset = 0
        for n, k in content:
            out[n].append((rank[n], k, bin_, offset))
            rank[n] += bins * k
            offset += n * k
        bin_ += bins
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    sequence_id is negative for a full piece, which is alone in its sequence.
    """
    spark = docs.sparkSession
    cut = Scratch(spark).keep(pieces(docs, tokenizer_path, capacity), "pieces")
    part = cut.where(F.col("length") < capacity)
    bins = Bins(capacity)
    bins.start({r["length"]: r["n"] for r in part.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()})
    bins.search()
    place = spark.sparkContext.broadcast(slots(bins.groups))
    # A document's rank among those of its length: its place in a share of them, after the sizes of the shares before.
    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(16 * partitions(spark)))
    rows = cut.withColumn("_share", share)
    sizes = rows.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_share")) - F.col("_n")).select("length", "_share", "_before")
    inner = rows.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = inner.join(before, ["length", "_share"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_in")).cast("long").alias("_rank"))

    def put(batches):
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            seq, offset = -1 - rank, np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                if n < capacity:
                    at, rows = np.flatnonzero(length == n), place.value[int(n)]
                    own = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                    away = rank[at] - own[:, 0]
                    seq[at], offset[at] = own[:, 2] + away // own[:, 1], own[:, 3] + away % own[:, 1] * n
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(seq), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
