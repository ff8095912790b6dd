"""Peer groups from overlapping sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("user", "fmp_peers", "proxy", "funds")


def exposure(rows: DataFrame) -> DataFrame:
    """Funds (symbol, weight) that are plain and not leveraged, by weight."""
    plain = F.col("weight").isNotNull() & (F.col("weight") <= 0.25) & ~F.col("symbol").rlike("[. ]")
    return rows.where(plain)


def overlap(holdings: DataFrame, top: int = 50) -> DataFrame:
    """symbol, fund_count over the `top` heaviest holdings of each fund (fund, symbol, weight); cash and nulls don't count."""
    rows = holdings.where("weight is not null and symbol is not null and not startswith(symbol, '$')")
    rank = F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("weight"), "symbol"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= top).groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.count(F.lit(1)).alias("fund_count"))


def merge(named: DataFrame, counts: DataFrame) -> DataFrame:
    """symbol, sources (in canonical order), fund_count of candidates named by sources (symbol, source)."""
    union = named.unionByName(counts.select("symbol", F.lit("funds").alias("source")))
    seen = union.groupBy("symbol").agg(F.collect_set("source").alias("_s"))
    ordered = F.filter(F.array(*[F.lit(s) for s in ORDER]), lambda s: F.array_contains("_s", s))
    return seen.join(counts, "symbol", "left").select("symbol", F.array_join(ordered, ",").alias("sources"), F.coalesce("fund_count", F.lit(0)).cast("long").alias("fund_count"))


def hygienic(etf: Column, fund: Column, active: Column) -> Column:
    """Neither ETF nor fund, and not known to be inactive."""
    return ~F.coalesce(etf, F.lit(False)) & ~F.coalesce(fund, F.lit(False)) & ~F.coalesce(~active, F.lit(False))


def pin_and_fill(candidates: DataFrame, top: int = 5) -> DataFrame:
    """tier (selected, runner_up), place of candidates (group, symbol, pin, rank): pins first, then ranks, then names."""
    order = Window.partitionBy("grp").orderBy(F.col("pin").isNull(), "pin", F.col("rank").isNull(), "rank", "symbol")
    place = F.row_number().over(order).cast("long")
    return candidates.select("grp", "symbol", place.alias("place"), F.when(place <= top, "selected").otherwise("runner_up").alias("tier"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The middle value, the upper one of two, by ranks: no list of a group is held."""
    w = Window.partitionBy(key).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n).where(F.col("_i") == F.floor(F.col("_n") / 2)).select(key, F.col(value).alias("median"), F.col("_n").cast("long").alias("n"))
