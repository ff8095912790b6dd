"""Queries over market, fundamental and peer data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import market as M
from tarnbeck.operators import peers as P
from tarnbeck.plans.base import BARS, YEARS, Tables, query


def _bars(t: Tables):
    return M.daily_bars(t.ticks())


@query("A08_daily_bars", f"WITH {BARS} SELECT * FROM bars")
def daily(t: Tables):
    return _bars(t)


_WEEK = "cast(day + cast((12 - isodow(day)) % 7 AS INTEGER) AS DATE)"
_WEEKS = f"WITH {BARS}, weeks AS (SELECT symbol, {_WEEK} AS week, arg_min(open, day) AS open, max(high) AS high, min(low) AS low, arg_max(close, day) AS close, cast(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL)"


@query("E10_weekly_bars", f"{_WEEKS} SELECT * FROM weeks")
def weekly(t: Tables):
    return M.weekly(_bars(t))


_W = "(PARTITION BY symbol ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("F01_moving_averages", f"WITH {BARS} SELECT symbol, day, " + ", ".join(f"round(CASE WHEN count(close) OVER {_W.format(n - 1)} = {n} THEN avg(close) OVER {_W.format(n - 1)} END, 2) AS sma{n}" for n in (5, 20, 50)) + " FROM bars")
def averages(t: Tables):
    return _bars(t).select("symbol", "day", *[F.round(M.moving_average(n), 2).alias(f"sma{n}") for n in (5, 20, 50)])


@query("F02_bollinger", f"WITH {BARS}, b AS (SELECT symbol, day, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS m, stddev_pop(close) OVER w AS d FROM bars WINDOW w AS {_W.format(19)}) SELECT symbol, day, round(m + 2 * d, 2) AS upper, round(m - 2 * d, 2) AS lower FROM b")
def bands(t: Tables):
    upper, lower = M.bollinger()
    return _bars(t).select("symbol", "day", F.round(upper, 2).alias("upper"), F.round(lower, 2).alias("lower"))


def _fold(n: int, factor: str) -> str:
    return f"list_reduce(list_prepend(list_avg(x[1:{n}]), x[{n + 1}:]), lambda a, b: a + {factor} * (b - a))"


@query("F03_rsi", f"WITH {BARS}, d AS (SELECT symbol, day, close - lag(close) OVER (PARTITION BY symbol ORDER BY day) AS d FROM bars), u AS (SELECT symbol, list(greatest(d, 0) ORDER BY day) AS u, list(greatest(-d, 0) ORDER BY day) AS v FROM d WHERE d IS NOT NULL GROUP BY symbol HAVING count(*) >= 14), r AS (SELECT symbol, {_fold(14, '(1/14.0::DOUBLE)').replace('x[', 'u[')} AS u, {_fold(14, '(1/14.0::DOUBLE)').replace('x[', 'v[')} AS v FROM u) SELECT symbol, round(CASE WHEN u + v = 0 THEN 50 ELSE 100 * u / (u + v) END, 2) AS rsi FROM r")
def rsi(t: Tables):
    return M.rsi(_bars(t))


@query("F04_ema", f"WITH {BARS}, l AS (SELECT symbol, list(close ORDER BY day) AS x FROM bars GROUP BY symbol) SELECT symbol, round({_fold(12, '(2/13.0::DOUBLE)')}, 4) AS ema FROM l WHERE len(x) >= 12")
def ema(t: Tables):
    return M.ema(_bars(t), 12)


@query("F05_atr", f"WITH {BARS}, r AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS p FROM bars), l AS (SELECT symbol, list(greatest(high - low, abs(high - p), abs(low - p)) ORDER BY day) AS x FROM r WHERE p IS NOT NULL GROUP BY symbol) SELECT symbol, round({_fold(14, '(1/14.0::DOUBLE)')}, 2) AS atr FROM l WHERE len(x) >= 14")
def atr(t: Tables):
    return M.atr(_bars(t))


@query("F06_average_volume", f"WITH {BARS} SELECT symbol, day, round(avg(volume) OVER {_W.format(19)}, 0) AS average_volume FROM bars")
def volume(t: Tables):
    return _bars(t).select("symbol", "day", F.round(F.avg("volume").over(M._frame(20)), 0).alias("average_volume"))


@query("F09_relative_strength", f"{_WEEKS}, r AS (SELECT w.symbol, w.week, w.close / nullif(b.close, 0) AS rs FROM weeks w JOIN weeks b ON b.week = w.week AND b.symbol = 'view' WHERE w.symbol <> 'view') SELECT symbol, week, round(rs / first_value(rs) OVER (PARTITION BY symbol ORDER BY week), 6) AS rs FROM r")
def strength(t: Tables):
    return M.relative_strength(M.weekly(_bars(t)), "view")


@query("D22_as_of_price", f"WITH {BARS}, p AS (SELECT DISTINCT event_type AS symbol, d AS period FROM events, (VALUES (date '2023-12-31'), (date '2024-01-07'), (date '2024-01-20'), (date '2024-03-01')) v(d)) SELECT p.symbol, period, arg_max(close, day) AS close FROM p LEFT JOIN bars b ON b.symbol = p.symbol AND day <= period GROUP BY ALL")
def as_of(t: Tables):
    days = F.array(*[F.lit(d).cast("date") for d in ("2023-12-31", "2024-01-07", "2024-01-20", "2024-03-01")])
    bars = _bars(t)
    return M.as_of(bars.select("symbol").distinct().select("symbol", F.explode(days).alias("period")), bars)


@query("F10_revenue_growth", f"WITH {YEARS} SELECT symbol, period, round((revenue / nullif(lag(revenue) OVER (PARTITION BY symbol ORDER BY period), 0) - 1) * 100, 2) AS growth FROM years")
def growth(t: Tables):
    return M.growth(t.years())


@query("I19_margins", f"WITH {YEARS} SELECT symbol, period, round((revenue - 900 * quantity) / nullif(revenue, 0) * 100, 2) AS margin FROM years")
def margins(t: Tables):
    return t.years().select("symbol", "period", F.round(F.try_divide(F.col("revenue") - 900 * F.col("quantity"), F.col("revenue")) * 100, 2).alias("margin"))


@query("E03_trailing_four", f"WITH {YEARS} SELECT symbol, CASE WHEN count(revenue) = 4 THEN round(sum(revenue), 2) END AS ttm FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period DESC) AS n FROM years) WHERE n <= 4 GROUP BY symbol")
def trailing(t: Tables):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period")))
    return t.years().withColumn("n", n).where("n <= 4").groupBy("symbol").agg(F.when(F.count("revenue") == 4, F.round(F.sum("revenue"), 2)).alias("ttm"))


@query("E13_price_band", f"WITH {BARS} SELECT symbol, min(close) AS low, max(close) AS high FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS n FROM bars) WHERE n <= 252 GROUP BY symbol")
def band(t: Tables):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    return _bars(t).withColumn("n", n).where("n <= 252").groupBy("symbol").agg(F.min("close").alias("low"), F.max("close").alias("high"))


@query("F11_last_non_null", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id")
def last_value(t: Tables):
    return t("events").where("value is not null").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_HOLD = "h AS (SELECT l_suppkey AS fund, 'p' || l_partkey AS symbol, cast(sum(cast(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL)"
_COUNTS = f"{_HOLD}, c AS (SELECT upper(trim(symbol)) AS symbol, count(*) AS fund_count FROM (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, symbol) AS r FROM h) WHERE r <= 50 GROUP BY 1)"


def _counts(t: Tables):
    weight = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return P.overlap(t("lineitem").groupBy(F.col("l_suppkey").alias("fund"), F.concat(F.lit("p"), "l_partkey").alias("symbol")).agg(weight.alias("weight")))


@query("E01_fund_overlap", f"WITH {_COUNTS} SELECT * FROM c")
def overlap(t: Tables):
    return _counts(t)


@query("E02_candidate_merge", f"WITH {_COUNTS}, n AS (SELECT 'P' || p_partkey AS symbol, CASE p_size % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'fmp_peers' ELSE 'proxy' END AS source FROM part WHERE p_size <= 20 UNION SELECT symbol, 'funds' FROM c), s AS (SELECT symbol, list(DISTINCT source) AS s FROM n GROUP BY symbol) SELECT s.symbol, array_to_string(list_filter(['user', 'fmp_peers', 'proxy', 'funds'], lambda x: list_contains(s.s, x)), ',') AS sources, coalesce(fund_count, 0) AS fund_count FROM s LEFT JOIN c ON c.symbol = s.symbol")
def candidates(t: Tables):
    source = F.when(F.col("p_size") % 3 == 0, "user").when(F.col("p_size") % 3 == 1, "fmp_peers").otherwise("proxy")
    return P.merge(t("part").where("p_size <= 20").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), source.alias("source")), _counts(t))


@query("C15_exposure_prefilter", f"WITH {_HOLD}, w AS (SELECT fund, symbol, round(weight / sum(weight) OVER (PARTITION BY fund), 6) AS weight FROM h) SELECT fund, symbol, weight FROM w WHERE weight <= 0.25")
def exposure(t: Tables):
    weight = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    h = t("lineitem").groupBy(F.col("l_suppkey").alias("fund"), F.concat(F.lit("p"), "l_partkey").alias("symbol")).agg(weight.alias("w"))
    return P.exposure(h.select("fund", "symbol", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("fund")), 6).alias("weight")))


@query("C17_hygiene_filter", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_custkey % 7 = 0, false) AND NOT coalesce(c_acctbal < 0, false) AND (CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 11 <> 0 END) IS DISTINCT FROM false")
def hygiene(t: Tables):
    active = F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_custkey") % 11 != 0)
    return t("customer").where(P.hygienic(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") < 0, active)).select("c_custkey")


_PIN = "CASE WHEN c_custkey % 50 = 0 THEN c_custkey END AS pin, CASE WHEN c_custkey % 3 = 0 THEN cast(round(c_acctbal) AS BIGINT) END AS rank"


@query("G05_pin_and_fill", f"SELECT grp, symbol, n AS place, CASE WHEN n <= 5 THEN 'selected' ELSE 'runner_up' END AS tier FROM (SELECT grp, symbol, row_number() OVER (PARTITION BY grp ORDER BY pin IS NULL, pin, rank IS NULL, rank, symbol) AS n FROM (SELECT c_nationkey AS grp, c_name AS symbol, {_PIN} FROM customer))")
def pin_and_fill(t: Tables):
    pin = F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey"))
    rank = F.when(F.col("c_custkey") % 3 == 0, F.round("c_acctbal").cast("long"))
    return P.pin_and_fill(t("customer").select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("symbol"), pin.alias("pin"), rank.alias("rank")))


@query("E12_upper_median", "SELECT c_nationkey AS grp, median, n FROM (SELECT c_nationkey, c_acctbal AS median, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE i = n // 2")
def upper_median(t: Tables):
    return P.upper_median(t("customer").select(F.col("c_nationkey").alias("grp"), "c_acctbal"), "grp", "c_acctbal")


@query("E14_fold_to_other", "WITH s AS (SELECT o_orderpriority AS grp, c_mktsegment AS name, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, name) AS r, count(*) OVER (PARTITION BY grp) AS n FROM s) SELECT grp, CASE WHEN n <= 4 OR r <= 3 THEN name ELSE 'Other' END AS name, round(sum(value), 2) AS value FROM r GROUP BY ALL")
def fold(t: Tables):
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("name"))
    s = t("orders").join(c, "o_custkey").groupBy(F.col("o_orderpriority").alias("grp"), "name").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return M.fold_small(s, "grp", "name", "value")


@query("D20_candidate_ranking_join", "SELECT coalesce(c.k, s.k) AS symbol, c.v AS balance, s.v AS rank FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) s ON s.k = c.k")
def ranking_join(t: Tables):
    c = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").alias("balance"))
    return c.join(t("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("rank")), "symbol", "full_outer")


@query("I28_short_names", "SELECT s_suppkey, substring(regexp_replace(s_name || ' Holdings, Inc.', '(?i)[,\\s]+(inc|corp|corporation|company|co|ltd|plc|llc|holdings|group)\\.?$', ''), 1, 26) AS name FROM supplier")
def names(t: Tables):
    return t("supplier").select("s_suppkey", T.short_company(F.concat("s_name", F.lit(" Holdings, Inc."))).alias("name"))


@query("I27_money", "SELECT o_orderkey, CASE WHEN abs(v) >= 1e12 THEN printf('%.1f', v / 1e12) || 'T' WHEN abs(v) >= 1e9 THEN printf('%.1f', v / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN printf('%.1f', v / 1e6) || 'M' WHEN abs(v) >= 1e3 THEN printf('%.1f', v / 1e3) || 'K' ELSE printf('%.1f', v) END AS money FROM (SELECT o_orderkey, cast(o_orderkey * 1234567 + 250 AS DOUBLE) AS v FROM orders)")
def money(t: Tables):
    return t("orders").select("o_orderkey", T.money((F.col("o_orderkey") * 1234567 + 250).cast("double")).alias("money"))


@query("G08_newest_first_caps", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS n FROM events) WHERE n <= 20")
def newest(t: Tables):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("ts"), "event_id"))
    return t("events").withColumn("n", n).where("n <= 20").select("user_id", "event_id")


@query("F13_occurrence_counter", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events")
def occurrences(t: Tables):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").select("event_id", F.row_number().over(w).cast("long").alias("k"))


@query("F12_first_appearance_number", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS number FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL)")
def numbering(t: Tables):
    first = t("events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("number"))


@query("F21_monotonic_dates", "SELECT user_id, bool_and(coalesce(d >= p, true)) OR bool_and(coalesce(d <= p, true)) AS monotonic FROM (SELECT user_id, cast(ts AS DATE) AS d, lag(cast(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id")
def monotonic(t: Tables):
    d = F.to_date("ts")
    p = F.lag(d).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t("events").select("user_id", d.alias("d"), p.alias("p"))
    return rows.groupBy("user_id").agg((F.bool_and(F.coalesce(F.col("d") >= F.col("p"), F.lit(True))) | F.bool_and(F.coalesce(F.col("d") <= F.col("p"), F.lit(True)))).alias("monotonic"))
