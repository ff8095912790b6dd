"""Centroid clustering of integer vectors by partial-distance search.

A vector is kept if it has exactly DIMENSIONS components, none of them null or non-finite; each component x becomes the
integer floor(256 * x). The first centroids are the K kept vectors with the smallest sha256 of `2:<vec_id>`. Each round
assigns every vector to its nearest centroid (ties: the smaller number) and moves each centroid to the exact floored
mean of its vectors; a centroid without vectors stays.

Search: dimensions are taken in falling order of their variance over all vectors. The squared differences of the first
of them are summed for every centroid; the one with the smallest partial sum is finished and its distance is the best so
far. A centroid whose partial sum is strictly above the best is abandoned, the others go on by some dimensions at a time,
and those that are left after the last dimension have their full distance. All sums are integers, so the order of the
dimensions changes the work alone, never the result.

What a round shuffles is one row for each task, centroid and dimension; the driver sees their sums alone, as many as
centroids have components. Nothing is grouped by vector or cluster, so equal vectors or one large cluster weigh no more than others.

Cases: an empty table, or one without a kept vector, gives no rows; with fewer than K kept vectors there are as many
centroids. Null vec_ids are hashed as `2:` and stay null; repeated rows are vectors of their own (equal hashes: the
smaller components go first). Components beyond 2 ** 27 are reckoned in Python's unbounded integers, and distances or
inertias that don't fit a long are given as the largest long. Extra columns fall away.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch

DIMENSIONS, K, ROUNDS = 64, 40, 5
#: Dimensions that a step of the search adds.
STEP = 8
#: Vectors that one NumPy step works on: with K centroids a few megabytes.
BLOCK = 4096
#: Largest component of the fast path: squared differences of 64 of them fit a long.
NARROW = 1 << 27
#: Sums are shuffled in digits of this base, so that no sum of them overflows decimal(38, 0).
BASE = 10**24
MOST = (1 << 63) - 1


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, x (doubles) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    real = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == DIMENSIONS) & real)


def whole(x: float) -> int:
    """floor(256 * x) of any finite number; beyond 2 ** 53 every double is an integer itself."""
    return math.floor(256 * x) if abs(x) < 1 << 53 else 256 * int(x)


def integers(x: np.ndarray) -> np.ndarray:
    """The rows of doubles as integers: int64, or Python's own where one of them is large."""
    if not x.size or np.abs(x).max() < NARROW // 256:
        return np.floor(256 * x).astype(np.int64)
    return np.array([[whole(v) for v in row] for row in x.tolist()], dtype=object)


def blocks(batches):
    """(vec_id column, integers) of at most BLOCK vectors each."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            some = batch.slice(i, BLOCK)
            flat = some.column("x").flatten().to_numpy(zero_copy_only=False)
            yield some.column("vec_id"), integers(flat.reshape(-1, DIMENSIONS))


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid."""
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    v, c = vectors[:, order], centroids[:, order]
    partial = sum((v[:, None, d] - c[None, :, d]) ** 2 for d in range(min(step, v.shape[1])))
    leader = partial.argmin(axis=1)
    best = ((v - c[leader]) ** 2).sum(axis=1)
    row, number = np.nonzero(partial <= best[:, None])
    total = partial[row, number]
    for at in range(step, v.shape[1], step):
        total = total + ((v[row, at : at + step] - c[number, at : at + step]) ** 2).sum(axis=1)
        on = (total <= best[row]).astype(bool)
        row, number, total = row[on], number[on], total[on]
    # Survivors lie by vector, then by number: the first of the smallest is the answer.
    first = np.searchsorted(row, np.arange(len(v)))
    least = np.minimum.reduceat(total, first)
    hit = (total == least[row]).astype(bool)
    return number[hit][np.searchsorted(row[hit], np.arange(len(v)))], least


def digits(values: list[int]) -> list[list[int]]:
    """Rows of digits to BASE, the lowest first; the last row holds the rest with its sign."""
    rows = []
    while any(not -BASE < v < BASE for v in values):
        rows.append([v % BASE for v in values])
        values = [v // BASE for v in values]
    return [*rows, values]


def _sums(rows: DataFrame, value) -> dict[int, list]:
    """Exact sums by key of what value(integers) gives: (key of each vector, columns of numbers)."""

    def partial(batches):
        count, total = {}, {}
        for _, v in blocks(batches):
            keys, numbers = value(v)
            for k in np.unique(keys).tolist():
                own = numbers[keys == k]
                # int64 sums of a block are exact: BLOCK * 2 ** 55 at most
                sums = [int(s) for s in own.sum(axis=0)]
                count[k] = count.get(k, 0) + len(own)
                total[k] = [a + b for a, b in zip(total[k], sums, strict=True)] if k in total else sums
        out = [(k, i, count[k] if not i else 0, [str(d) for d in row]) for k in total for i, row in enumerate(digits(total[k]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], ["key", "digit", "n", "sums"])

    parts = rows.mapInArrow(partial, "key int, digit int, n long, sums array<string>")
    each = parts.select("key", "digit", "n", F.posexplode("sums").alias("at", "s"))
    sums = each.groupBy("key", "digit", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, list] = {}
    for key, digit, at, n, s in sums.collect():  # a few digits of the sums of K keys
        own = found.setdefault(key, [0, [0] * 2 * DIMENSIONS])
        own[0] = max(own[0], n)  # counted in the lowest digit alone
        own[1][at] += int(s) * BASE**digit
    return found


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hashes: k rows come to the driver."""
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return integers(np.array([r["x"] for r in rows.orderBy(digest, "x").limit(k).collect()], float).reshape(-1, DIMENSIONS))


def by_variance(rows: DataFrame) -> np.ndarray:
    """The dimensions, those of high variance first."""

    def moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Squares of 2 ** 27 in 4096 rows: below 2 ** 63.
        return np.zeros(len(v), np.int32), np.hstack([v, v * v])

    n, sums = _sums(rows, moments)[0]
    spread = [n * sums[DIMENSIONS + d] - sums[d] ** 2 for d in range(DIMENSIONS)]
    return np.array(sorted(range(DIMENSIONS), key=lambda d: (-spread[d], d)))


def moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    sums = _sums(rows, lambda v: (nearest(v, centroids, order)[0], v))
    new = centroids.tolist()
    for number, (n, total) in sums.items():
        new[number] = [s // n for s in total[:DIMENSIONS]]
    small = all(abs(x) <= NARROW for c in new for x in c)
    return np.array(new, dtype=np.int64 if small else object)


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def assigned(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""

    def assign(batches):
        for ids, v in blocks(batches):
            number, distance = nearest(v, centroids, order)
            far = pa.array([min(int(d), MOST) for d in distance] if distance.dtype == object else distance, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(assign, "vec_id long, cluster int, distance long")


def _as_long(total: Column) -> Column:
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of vectors (vec_id, embedding)."""
    spark, rows = vectors.sparkSession, kept(vectors)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order = by_variance(rows)
    for _ in range(rounds):
        centroids = moved(rows, centroids, order)
    found = Scratch(spark).keep(assigned(rows, centroids, order), "assigned")
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows at most
    each = [(r["cluster"], min(int(r["own"]), MOST), min(sum(int(x["own"]) for x in own), MOST), digest(centroids[r["cluster"]])) for r in own]
    totals = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The rounds one after another, with all full distances and without any order of dimensions."""
    steps = [f"""
own AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM own QUALIFY k < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT vec_id, r, own.v, min((list_sum(list_transform(list_zip(own.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c{i}.k)) AS best FROM own, c{i} GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT k, list(cast(floor(s / n) AS BIGINT) - CASE WHEN cast(floor(s / n) AS BIGINT) * n > s THEN 1 ELSE 0 END ORDER BY d) AS v FROM (
  SELECT best[2] AS k, d, sum(v[d])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {dimensions + 1}) t(d) GROUP BY ALL) GROUP BY k),
c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.k = c{i}.k)""")
    last = f"a{rounds}"
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, cast(best[2] AS INTEGER) AS cluster, best[1] AS distance, cast(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  cast(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} c ON c.k = best[2]"""


ORACLE = _oracle()
