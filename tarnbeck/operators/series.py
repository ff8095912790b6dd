"""Technical records, cohorts and enrichment of peers, trailing multiples, orders of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.operators.market import _mean, _series, as_of

FAST, SLOW, SIGNAL = 12, 26, 9


def _next(n: int, before: Column, x: Column) -> Column:
    return before + F.lit(2 / (n + 1)) * (x - before)


def macd(bars: DataFrame) -> DataFrame:
    """symbol, macd, signal, histogram after the last bar; both averages start at bar SLOW from a plain mean of their
    last bars, the signal from the mean of the first SIGNAL values. Null where there are too few bars."""
    x = F.transform("s", lambda b: b["close"])
    series = _series(bars, "close").select("symbol", x.alias("x")).where(F.size("x") >= SLOW + SIGNAL - 1)
    begin = F.struct(_mean(F.slice("x", SLOW - FAST + 1, FAST)).alias("f"), _mean(F.slice("x", 1, SLOW)).alias("s"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("signal"), F.lit(1).alias("k"))
    first = F.struct(begin["f"].alias("f"), begin["s"].alias("s"), (begin["f"] - begin["s"]).alias("sum"), F.lit(0.0).alias("signal"), F.lit(1).alias("k"))

    def step(a: Column, v: Column) -> Column:
        fast, slow, k = _next(FAST, a["f"], v), _next(SLOW, a["s"], v), a["k"] + 1
        line, total = fast - slow, a["sum"] + fast - slow
        signal = F.when(k < SIGNAL, 0.0).when(k == SIGNAL, total / SIGNAL).otherwise(_next(SIGNAL, a["signal"], line))
        return F.struct(fast.alias("f"), slow.alias("s"), total.alias("sum"), signal.alias("signal"), k.alias("k"))

    last = F.aggregate(F.slice("x", SLOW + 1, F.size("x") - SLOW), first, step)
    out = series.select("symbol", last.alias("e"))
    return out.select("symbol", F.round(F.col("e.f") - F.col("e.s"), 4).alias("macd"), F.round("e.signal", 4).alias("signal"), F.round(F.col("e.f") - F.col("e.s") - F.col("e.signal"), 4).alias("histogram"))


def signals() -> dict[str, Column]:
    """The twelve signals of a technical record; null where a value that one needs is missing."""
    c = F.col
    return {
        "golden_cross": c("sma50") > c("sma200"),
        "death_cross": c("sma50") <= c("sma200"),
        "above_sma20": c("close") > c("sma20"),
        "above_sma50": c("close") > c("sma50"),
        "above_sma200": c("close") > c("sma200"),
        "rsi_overbought": c("rsi") > 70,
        "rsi_oversold": c("rsi") < 30,
        "macd_bullish": c("histogram") > 0,
        "macd_bearish": c("histogram") < 0,
        "above_upper_bb": F.when(c("lower").isNotNull(), c("close") > c("upper")),
        "below_lower_bb": F.when(c("upper").isNotNull(), c("close") < c("lower")),
        "volume_above_avg": F.when(c("average_volume") > 0, c("volume") > c("average_volume")),
    }


def band_position() -> Column:
    """Where the close stands to the Bollinger bands, in words."""
    c = F.col
    share = (c("close") - c("lower")) / (c("upper") - c("lower")) * 100
    inside = F.format_string("Price is at %.0f%% of the Bollinger Band range.", share)
    flat = F.format_string("Bollinger Bands are flat at $%.2f.", c("upper"))
    return F.when(c("close") > c("upper"), "Price is above the upper Bollinger Band (potential overbought).").when(c("close") < c("lower"), "Price is below the lower Bollinger Band (potential oversold).").when(c("upper") != c("lower"), inside).otherwise(flat)


def trailing_multiples(earnings: DataFrame, prices: DataFrame) -> DataFrame:
    """symbol, periods, last, average of close at a period's end over its earnings (symbol, period, eps), of symbols with
    two positive ones or more."""
    paid = as_of(earnings.where("eps > 0").select("symbol", "period"), prices).where("close is not null").join(earnings, ["symbol", "period"]).withColumn("multiple", F.col("close") / F.col("eps"))
    out = paid.groupBy("symbol").agg(F.count(F.lit(1)).alias("periods"), F.round(F.max_by("multiple", "period"), 4).alias("last"), F.round(F.avg("multiple"), 4).alias("average"))
    return out.where("periods >= 2")


def enriched(rows: DataFrame, profiles: DataFrame, revenues: DataFrame) -> DataFrame:
    """rows (symbol) with name (empty without a profile), market_cap and revenue (null where unknown)."""
    return rows.join(profiles, "symbol", "left").join(revenues, "symbol", "left").select("symbol", F.coalesce("name", F.lit("")).alias("name"), "market_cap", "revenue")


def cohort(selected: DataFrame, metrics: DataFrame) -> DataFrame:
    """grp, symbol, subject, missing, forward_pe of each subject with metrics (symbol, forward_pe) and its peers; selected:
    grp, symbol, subject."""
    known = metrics.select("symbol", "forward_pe", F.lit(True).alias("_k"))
    rows = selected.join(known, "symbol", "left")
    there = rows.where("subject AND _k").select("grp").distinct()
    return rows.join(there, "grp", "left_semi").select("grp", "symbol", "subject", F.col("_k").isNull().alias("missing"), "forward_pe")


def cohort_order(rows: DataFrame) -> DataFrame:
    """grp, symbol, place of cohort members with a multiple: the subject, then the dearest."""
    w = Window.partitionBy("grp").orderBy(F.desc("subject"), F.desc("forward_pe"), "symbol")
    return rows.where("forward_pe is not null").select("grp", "symbol", F.row_number().over(w).cast("long").alias("place"))


def spread_labels(labels: DataFrame, least: float) -> DataFrame:
    """grp, name, at: label places (grp, name, value) pushed up until neighbours are `least` apart."""
    w = Window.partitionBy("grp").orderBy("value", "name")
    k = F.row_number().over(w) - 1
    free = labels.withColumn("_k", k)
    highest = F.max(F.col("value") - F.col("_k") * least).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return free.select("grp", "name", F.round(highest + F.col("_k") * least, 6).alias("at"))


def recent_first(uses: DataFrame) -> DataFrame:
    """grp, name, place of names by their last use (grp, name, ord), each once."""
    last = uses.groupBy("grp", "name").agg(F.max("ord").alias("ord"))
    return last.select("grp", "name", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("ord"), "name")).cast("long").alias("place"))


def longest_first(tasks: DataFrame) -> DataFrame:
    """grp, task, place in which tasks (grp, task, target) are dispatched."""
    return tasks.select("grp", "task", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("target"), "task")).cast("long").alias("place"))


def timeline(logs: DataFrame) -> DataFrame:
    """grp, task, place of logs (grp, task, started): undated ones last."""
    return logs.select("grp", "task", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("started").isNull(), "started", "task")).cast("long").alias("place"))
