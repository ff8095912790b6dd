"""Question ledger, batches, run accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batched(open_questions: DataFrame, most: int = 4) -> DataFrame:
    """section, ord, batch (from 1): chunks of four, a lone last one with the question before it for company."""
    w = Window.partitionBy("section").orderBy("ord")
    n, rn = F.count(F.lit(1)).over(Window.partitionBy("section")), F.row_number().over(w)
    plain = F.ceil(rn / most)
    lone = (n > most) & (n % most == 1) & (rn == n - 1)
    return open_questions.select("section", "ord", F.when(lone, plain + 1).otherwise(plain).cast("long").alias("batch"))


def waves(batches: DataFrame, parallel: int = 16) -> DataFrame:
    """With the wave of each batch, in the order of section and batch."""
    sizes = batches.select("section", "batch").distinct()
    # Batches are counted within sections and sections' batches before, so that no task sees every batch.
    per = sizes.groupBy("section").agg(F.count(F.lit(1)).alias("_k"))
    before = per.withColumn("_before", F.sum("_k").over(Window.orderBy("section")) - F.col("_k"))
    return sizes.join(before, "section").select("section", "batch", F.floor((F.col("_before") + F.col("batch") - 1) / parallel).cast("long").alias("wave"))


def next_status(status, attempts):
    """open questions are deferred at the third attempt; closed ones stay."""
    return F.when(status.isin("open", "reopened") & (attempts >= 3), "deferred").otherwise(status)


def one_for_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ord, value) of either side paired first to first; what is left over stands alone. Null keys match."""
    w = Window.partitionBy(*keys).orderBy("ord")
    a, b = (x.withColumn("_n", F.row_number().over(w)) for x in (left, right))
    a = a.select(*[F.col(k).alias(f"_a{k}") for k in keys], F.col("_n").alias("_an"), F.col("value").alias("left_value"))
    b = b.select(*[F.col(k).alias(f"_b{k}") for k in keys], F.col("_n").alias("_bn"), F.col("value").alias("right_value"))
    on = F.col("_an") == F.col("_bn")
    for k in keys:
        on = on & F.col(f"_a{k}").eqNullSafe(F.col(f"_b{k}"))
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"_a{k}", f"_b{k}").alias(k) for k in keys], F.coalesce("_an", "_bn").cast("long").alias("n"), "left_value", "right_value")
