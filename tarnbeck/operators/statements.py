"""Line items, ratios and flows of financial statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(value: Column, digits: int = 1) -> Column:
    return F.round(value * 100, digits)


def change(now: Column, before: Column) -> Column:
    """Percent by which an estimate moved, against the size of the earlier one; null after nothing or zero."""
    return percent(F.try_divide(now - before, F.abs(before)))


def implied_return(fair: Column, price: Column) -> Column:
    return percent(F.try_divide(fair, price) - 1, 2)


def filled_items() -> dict[str, Column]:
    """Gross profit, cost and operating expense of revenue, cost, gross, opex and operating, each from the others where it is missing."""
    c = F.col
    gross = F.coalesce(c("gross"), c("revenue") - c("cost"))
    cost = F.coalesce(c("cost"), c("revenue") - c("gross"))
    opex = F.coalesce(c("opex"), gross - c("operating"))
    return {"gross": gross, "cost": cost, "opex": opex, "operating": F.coalesce(c("operating"), gross - c("opex"))}


def enterprise_value(cap: Column, debt: Column, cash: Column) -> Column:
    return cap + F.coalesce(debt, F.lit(0)) - F.coalesce(cash, F.lit(0))


def diverges(computed: Column, reported: Column, share: float = 0.02) -> Column:
    """Whether a reported figure differs by more than `share` from the computed one; unknown or zero ones don't."""
    return F.coalesce(F.abs(F.try_divide(reported, computed) - 1) > share, F.lit(False))


def coverage(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Share of periods with a value."""
    return rows.groupBy(key).agg(F.round(F.count(value) / F.count(F.lit(1)), 2).alias("coverage"))


def gaps(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Periods without a value, in order, for the groups that have any."""
    missing = F.array_sort(F.collect_list(F.when(F.col(value).isNull(), F.col("period"))))
    return rows.groupBy(key).agg(F.array_join(missing, ", ").alias("gaps")).where("gaps <> ''")


def observations(rows: DataFrame, since: str) -> DataFrame:
    """Numbers of a published series (series, date, value as texts) since a day; marks for missing ones and odd dates fall away."""
    value = F.col("value").try_cast("double")
    return rows.where((F.length("date") == 10) & (F.col("date") >= since) & value.isNotNull()).select("series", "date", value.alias("value"))


def latest_spread(rows: DataFrame, long_end: str, short_end: str) -> DataFrame:
    """The latest value of one series less that of another."""
    last = lambda s: F.max_by(F.when(F.col("series") == s, F.col("value")), F.when(F.col("series") == s, F.col("date")))
    return rows.where(F.col("series").isin(long_end, short_end)).agg(F.round(last(long_end) - last(short_end), 4).alias("spread"))


def fold_sinks(edges: DataFrame, share: float = 0.0025) -> DataFrame:
    """Flows (statement, source, target, value, revenue) with the small ends of one source as `Other`, if there are two or more.

    An end is a target that is no source in its statement.
    """
    sources = edges.select("statement", F.col("source").alias("target"), F.lit(True).alias("_inner")).distinct()
    small = F.col("_inner").isNull() & (F.col("value") < F.col("revenue") * share)
    rows = edges.join(sources, ["statement", "target"], "left").withColumn("_small", small)
    n = F.sum(F.col("_small").cast("int")).over(Window.partitionBy("statement", "source"))
    target = F.when(F.col("_small") & (F.col("_n") >= 2), "Other").otherwise(F.col("target"))
    return rows.withColumn("_n", n).groupBy("statement", "source", target.alias("target")).agg(F.sum("value").alias("value"))


def stacked(nodes: DataFrame, gap: float) -> DataFrame:
    """Top of each node of a column (statement, level, node, value): nodes below each other by size, with a gap."""
    w = Window.partitionBy("statement", "level").orderBy(F.desc("value"), "node").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("value") + F.lit(gap)).over(w), F.lit(0.0))
    return nodes.select("statement", "level", "node", F.round(before, 4).alias("top"))
