"""Near-duplicate documents by b-bit MinHash.

1. Every text gives the digest of its shingle set, HASHES minima, of these the low BITS bits packed into words, and
   BANDS band keys of the full minima. Texts with equal sets become one class at once (a partial aggregation), so a
   group of copies costs one row further on.
2. Classes that share a band key are candidates. In each bucket the class with the most company in all its buckets is
   the pivot; pairs with a pivot come first. A pair's similarity is estimated from the equal packed values, counted by
   bits and corrected for chance collisions; pairs whose estimate is hopeless (5 standard deviations below the bound)
   go no further. Nor do pairs whose set sizes, or whose parities of shingle counts in LANES lanes, prove that too many
   shingles differ: lanes of unlike parity are at most the shingles that only one set has, so this drops no link.
3. The full sets of all other pairs are compared. Components of the links so far then say which buckets still hold
   classes of different components, and only pairs across components are compared, until no bucket is open: members
   of one component need no further pair, so a group of thousands costs about one comparison for each member. A pair
   is made in the first bucket that it shares alone.

With 40 bands of 4 minima a pair at similarity 0.75 escapes all bands with probability 3e-7.
Nulls count as empty texts; texts without words have the empty set and are linked with nothing; repeated rows are
documents of their own, and a null doc_id never becomes a component's name while another is there. Extra columns
fall away from the digest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch, blocks, numbered
from tarnbeck.llm.graph import components
from tarnbeck.llm.grams import Words, mix, shingles

K, SHARE = 5, (75, 100)
#: Minima, of which the first BANDS * ROWS make the band keys; all of them serve the estimate.
HASHES, BANDS, ROWS, BITS = 256, 40, 4, 4
WORDS = HASHES * BITS // 64
#: Lanes of the parity bits; sets of up to about half as many shingles are told apart nearly exactly.
LANES = 1024
_rng = np.random.default_rng(4242)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_C = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
#: Shingle sets that a worker keeps while it verifies pairs, by bytes.
MEMO_BYTES = 64_000_000


def text_sets(column: pa.Array):
    """Per text, its sorted distinct shingle hashes."""
    for i, j, buf, offs in blocks(column):
        grams, bounds = shingles(Words(buf, offs), K)
        for d in range(j - i):
            yield np.unique(grams[bounds[d] : bounds[d + 1]])


def _sketch(batches):
    names = ["rid", "doc_id", "n_shingles", "s1", "s2", "bands", "packed", "odd"]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
    for b in batches:
        for i, j, buf, offs in blocks(b.column("text")):
            grams, bounds = shingles(Words(buf, offs), K)
            n = j - i
            size, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            odd = [None] * n
            for d in range(n):
                own = np.unique(grams[bounds[d] : bounds[d + 1]])
                if len(own):
                    size[d] = len(own)
                    s1[d], s2[d] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    counts = np.bincount((own & np.uint64(LANES - 1)).astype(np.int64), minlength=LANES)
                    odd[d] = np.packbits((counts & 1).astype(np.uint8)).view(np.int64)
            full = np.flatnonzero(size)
            bands = [None] * n
            packed = [None] * n
            if len(full):
                x, starts = (grams >> np.uint64(32)).astype(np.uint32), bounds[:-1][full]
                low = np.empty((HASHES, len(full)), np.uint32)
                for h in range(HASHES):
                    low[h] = np.minimum.reduceat(x * _A[h] + _B[h], starts)
                wide = low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS, -1)
                keys = mix((wide * _C[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).T
                few = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(WORDS, 64 // BITS, -1)
                words = (few << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :, None]).sum(axis=1, dtype=np.uint64).view(np.int64).T
                for d, k, w in zip(full.tolist(), keys, words):
                    bands[d], packed[d] = k, w
            cols = [b.column("rid").slice(i, n), b.column("doc_id").slice(i, n), size, s1, s2, bands, packed, odd]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds)], names)


def estimate(a: str, b: str) -> F.Column:
    """Similarity from packed values: equal BITS-bit groups, less those that agree by chance."""
    differ = F.lit(0)
    lows = int("1" * 16, 16) if BITS == 4 else None
    for i in range(WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(lows))
        differ = differ + F.bit_count(y)
    chance = 1 / (1 << BITS)
    return ((HASHES - differ) / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def hopeless_below(share: float) -> float:
    chance = 1 / (1 << BITS)
    p = share + (1 - share) * chance
    return share - 5 * math.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def may_reach(a: str, b: str, share: tuple[int, int]) -> F.Column:
    """False where set sizes (n) or lane parities (o) prove a similarity below the share."""
    na, nb, unlike = F.col(f"n{a}"), F.col(f"n{b}"), F.lit(0)
    for i in range(LANES // 64):
        unlike = unlike + F.bit_count(F.col(f"o{a}")[i].bitwiseXOR(F.col(f"o{b}")[i]))
    sizes = F.least(na, nb) * share[1] >= F.greatest(na, nb) * share[0]
    # From common * (share[0] + share[1]) >= share[0] * (na + nb), and na + nb - 2 * common shingles differ.
    return sizes & (unlike * (share[0] + share[1]) <= (na + nb) * (share[1] - share[0]))


def _verify(share: tuple[int, int]):
    def verify(batches):
        memo, held = {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            found, text = {}, {}
            for side in "ab":
                ids = b.column(side).to_pylist()
                new = [k for k, r in enumerate(ids) if r not in memo and r not in text and not text.__setitem__(r, k)]
                for k, own in zip(new, text_sets(b.column(f"text_{side}").take(pa.array(new, pa.int64())))):
                    found[ids[k]] = own
                    held += own.nbytes
            memo |= found
            ok = []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                p, q = memo[x], memo[y]
                both = np.concatenate([p, q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(share[1] * common >= share[0] * (len(p) + len(q) - common) and common > 0)
            if held > MEMO_BYTES:
                memo, held = {}, 0
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], ["a", "b", "linked"])

    return verify


def classes(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """rid, doc_id, n_shingles, cls (rid that stands for equal sets), component (smallest rid reachable) for every row of docs (rid, doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    schema = "rid long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, packed array<long>, odd array<long>"
    sketch = scratch.keep(rows.select("rid", F.col("doc_id").cast("long"), "text").mapInArrow(_sketch, schema), "sketches")
    kinds = sketch.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("rid").alias("cls"))
    heads = sketch.join(kinds.select(F.col("cls").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("cls"), "bands", "packed")
    spread = heads.select("cls", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.keep(spread.join(shared, "key"), "met")
    # A bucket's pivot is its class with the most company in all its buckets: the original among its copies.
    company = met.groupBy("cls").agg(F.sum("n").alias("company"))
    pivot = met.join(company, "cls").groupBy("key").agg(F.max_by("cls", F.struct("company", -F.col("cls"))).alias("pivot"))
    members = scratch.keep(met.select("key", "cls").join(pivot, "key"), "buckets")
    scratch.drop(met)
    some = members.select(F.col("cls").alias("rid")).distinct()
    packed = scratch.keep(sketch.join(some, "rid", "left_semi").select("rid", "n_shingles", "packed", "odd", "bands"), "packed")
    texts = scratch.keep(rows.select("rid", "text").join(some, "rid", "left_semi"), "texts")
    floor = hopeless_below(share[0] / share[1])
    done: list[DataFrame] = []
    links: DataFrame | None = None
    root: DataFrame | None = None

    def check(pairs: DataFrame) -> DataFrame:
        """a, b, linked of the pairs whose estimate leaves hope."""
        a, b = (packed.select(F.col("rid").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("packed").alias(f"p{s}"), F.col("odd").alias(f"o{s}")) for s in "ab")
        likely = pairs.join(a, "a").join(b, "b").where(may_reach("a", "b", share) & (estimate("pa", "pb") >= floor)).select("a", "b")
        ta, tb = (texts.select(F.col("rid").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        # Equal pivots come one after another, so that a worker makes their sets once.
        both = likely.join(tb, "b").join(ta, "a").sortWithinPartitions("a").select("a", "b", "text_a", "text_b")
        return scratch.keep(both.mapInArrow(_verify(share), "a long, b long, linked boolean"), "pairs")

    def roots() -> DataFrame:
        return components(links, scratch)

    def labelled() -> DataFrame:
        """Bucket members with their component so far."""
        return members.join(root.select(F.col("node").alias("cls"), "root"), "cls", "left").select("key", "pivot", "cls", F.coalesce("root", "cls").alias("comp"))

    # Each class with the pivot that it shares most buckets with.
    pivots = members.where("cls <> pivot").groupBy(F.col("pivot").alias("a"), F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = pivots.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done.append(check(best))
    links = done[0].where("linked").select("a", "b")
    root = roots()
    # Then all pivots of another component, then all pairs across components in buckets that are still open.
    for every in (False, True):
        at = scratch.keep(labelled(), "labels")
        spans = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        left = at.join(spans, "key", "left_semi")
        if every:
            signed = left.join(packed.select(F.col("rid").alias("cls"), "n_shingles", "odd", "bands"), "cls")
            x, y = (signed.select("key", F.col("cls").alias(s), F.col("comp").alias(f"c{s}"), F.col("n_shingles").alias(f"n{s}"), F.col("odd").alias(f"o{s}"), F.col("bands").alias(f"b{s}")) for s in "ab")
            # One side leaves out the bucket's most frequent component: it can be the giant.
            sizes = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
            less = x.join(sizes, "key").where("ca <> main")
            once = F.get(F.array_intersect("ba", "bb"), 0) == F.col("key")
            pairs = less.join(y, "key").where(F.expr("ca <> cb and (cb = main or ca < cb)") & may_reach("a", "b", share) & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        else:
            own = left.where("cls = pivot").select("key", F.col("comp").alias("pc"))
            pairs = left.join(own, "key").where("comp <> pc").select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()
        for d in done:
            pairs = pairs.join(d.select("a", "b"), ["a", "b"], "left_anti")
        done.append(check(pairs))
        new = done[-1].where("linked").select("a", "b")
        if not new.isEmpty():  # else the components are as before
            links = links.union(new)
            root = roots()
        scratch.drop(at)
    scratch.drop(texts, packed, members)
    of = sketch.select("rid", "doc_id", "n_shingles", "s1", "s2")
    with_class = of.where("n_shingles > 0").join(kinds, ["s1", "s2"]).join(root.select(F.col("node").alias("cls"), "root"), "cls", "left")
    linked = with_class.select("rid", "doc_id", "n_shingles", "cls", F.coalesce("root", "cls").alias("component"))
    alone = of.where("n_shingles = 0").select("rid", "doc_id", "n_shingles", F.col("rid").alias("cls"), F.col("rid").alias("component"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id) for every row."""
    at = Scratch(docs.sparkSession).keep(classes(numbered(docs, "doc_id", "text"), share), "classes")
    names = at.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return at.join(names, "component").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of docs, all columns: one of each component, the one with the smallest doc_id (then the first row)."""
    rows = numbered(docs, name="_tb_rid")
    at = Scratch(docs.sparkSession).keep(classes(rows.select(F.col("_tb_rid").alias("rid"), "doc_id", "text"), share), "classes")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    first = at.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.rid").alias("_tb_rid"))
    return rows.join(first, "_tb_rid", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
