"""Market and fundamental series; bars are symbol, day, open, high, low, close, volume.

Smoothing starts from the mean of the first n values; Wilder's factor 1/n serves RSI and ATR, 2/(n+1) the EMA, and
deviations are those of the population. Recursive series are folds over one symbol's ordered values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame) -> DataFrame:
    """Bars of ticks (symbol, ts, tick, value); ties in time go by tick."""
    first, last = F.struct("ts", "tick"), F.struct("ts", "tick")
    return ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", last).alias("close"), F.count(F.lit(1)).alias("volume"))


def weekly(bars: DataFrame) -> DataFrame:
    """Bars of weeks that end on Friday; a week without a close is left out."""
    week = F.next_day(F.date_sub("day", 1), "FR")
    rows = bars.groupBy("symbol", week.alias("week")).agg(F.min_by("open", "day").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "day").alias("close"), F.sum("volume").alias("volume"))
    return rows.where("close is not null")


def _frame(n: int):
    return Window.partitionBy("symbol").orderBy("day").rowsBetween(-(n - 1), 0)


def moving_average(n: int) -> Column:
    """Null until n values are there."""
    return F.when(F.count("close").over(_frame(n)) == n, F.avg("close").over(_frame(n)))


def bollinger(n: int = 20, width: float = 2.0) -> tuple[Column, Column]:
    d = F.when(F.count("close").over(_frame(n)) == n, F.stddev_pop("close").over(_frame(n)))
    return moving_average(n) + width * d, moving_average(n) - width * d


def _series(bars: DataFrame, *columns: str) -> DataFrame:
    """Per symbol, its ordered rows as an array: a symbol has one bar a day, so the array is bounded by the calendar."""
    return bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", *columns))).alias("s"))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def smoothed(xs: Column, n: int, factor: float) -> Column:
    """The last smoothed value, from the mean of the first n; null with fewer."""
    return F.when(F.size(xs) >= n, F.aggregate(F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0))), _mean(F.slice(xs, 1, n)), lambda a, x: a + F.lit(factor) * (x - a)))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """symbol, rsi after the last bar."""
    s = _series(bars, "close")
    change = F.zip_with(F.slice("s", 2, F.size("s") - 1), F.slice("s", 1, F.size("s") - 1), lambda b, a: b["close"] - a["close"])
    d = s.where(F.size("s") > n).select("symbol", change.alias("d"))
    up = smoothed(F.transform("d", lambda x: F.greatest(x, F.lit(0.0))), n, 1 / n)
    down = smoothed(F.transform("d", lambda x: F.greatest(-x, F.lit(0.0))), n, 1 / n)
    return d.select("symbol", up.alias("u"), down.alias("v")).select("symbol", F.round(F.when(F.col("u") + F.col("v") == 0, 50.0).otherwise(100 * F.col("u") / (F.col("u") + F.col("v"))), 2).alias("rsi"))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """symbol, atr after the last bar."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    s = _series(bars.withColumn("tr", F.when(before.isNotNull(), true)).where("tr is not null"), "tr")
    return s.select("symbol", F.round(smoothed(F.transform("s", lambda x: x["tr"]), n, 1 / n), 2).alias("atr"))


def ema(bars: DataFrame, n: int) -> DataFrame:
    """symbol, ema after the last bar."""
    return _series(bars, "close").select("symbol", F.round(smoothed(F.transform("s", lambda x: x["close"]), n, 2 / (n + 1)), 4).alias("ema"))


def trend(rows: DataFrame) -> DataFrame:
    """Signals of the latest values (close, sma20, sma50, rsi, volume, average_volume): null where an input is."""
    return rows.select("symbol", (F.col("close") > F.col("sma20")).alias("above_sma20"), (F.col("sma20") > F.col("sma50")).alias("golden"), (F.col("rsi") > 70).alias("overbought"), (F.col("rsi") < 30).alias("oversold"), F.when(F.col("average_volume") > 0, F.col("volume") > F.col("average_volume")).alias("high_volume"))


def relative_strength(weeks: DataFrame, benchmark: str, shown: int = 209) -> DataFrame:
    """symbol, week, rs: close over the benchmark's on common weeks, 1 in the first of the last `shown` weeks."""
    other = weeks.where(F.col("symbol") == benchmark).select("week", F.col("close").alias("_b"))
    rows = weeks.where(F.col("symbol") != benchmark).join(other, "week").withColumn("_rs", F.try_divide("close", "_b"))
    recent = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("week")))
    first = F.first("_rs", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("_n", recent).where(F.col("_n") <= shown).select("symbol", "week", F.round(F.try_divide(F.col("_rs"), first), 6).alias("rs"))


def as_of(left: DataFrame, prices: DataFrame) -> DataFrame:
    """left (symbol, period) with the last close on or before the period's end: one sorted pass over both, no range join."""
    a = left.select("symbol", F.col("period").alias("day"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("close"))
    b = prices.select("symbol", "day", F.lit(0).alias("_side"), "close")
    w = Window.partitionBy("symbol").orderBy("day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("close", F.last("close", ignorenulls=True).over(w)).where("_side = 1").select("symbol", F.col("day").alias("period"), "close")


def growth(periods: DataFrame) -> DataFrame:
    """Year-on-year growth in percent over periods with a value; null after a zero."""
    before = F.lag("revenue").over(Window.partitionBy("symbol").orderBy("period"))
    return periods.where("revenue is not null").select("symbol", "period", F.round((F.try_divide(F.col("revenue"), before) - 1) * 100, 2).alias("growth"))


def fold_small(rows: DataFrame, group: str, name: str, value: str, keep: int = 3) -> DataFrame:
    """With more than keep + 1 names in a group, the largest `keep` and the sum of the others."""
    w = Window.partitionBy(group).orderBy(F.desc(value), name)
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    label = F.when((F.col("_n") <= keep + 1) | (F.col("_r") <= keep), F.col(name)).otherwise("Other")
    return rows.withColumn("_r", F.row_number().over(w)).withColumn("_n", n).groupBy(group, label.alias(name)).agg(F.round(F.sum(value), 2).alias(value))
