"""Queries over technical records, cohorts, multiples and orders of lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnbeck.operators import market as M
from tarnbeck.operators import series as S
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows

# An hour takes the place of a day, so that the series are long enough for all averages.
_HOURS = "SELECT event_type AS symbol, date_trunc('hour', ts) AS day, max(value) AS close, count(*) AS volume FROM {events} GROUP BY event_type, date_trunc('hour', ts)"
_LIST = f"x AS (SELECT symbol, list(close ORDER BY day) AS x FROM ({plain(_HOURS)}) GROUP BY symbol HAVING count(*) >= 34)"
# Smoothed values as weighted sums of the inputs after the seed.
_EMA = "(list_avg(x[{a}:26]) * pow(1 - 2 / {n}, i - 26) + coalesce(list_sum(list_transform(generate_series(27, i), lambda j: x[j] * 2 / {n} * pow(1 - 2 / {n}, i - j))), 0))"
_MACD = f"{_LIST}, t AS (SELECT symbol, x, unnest(generate_series(26, len(x))) AS i FROM x), l AS (SELECT symbol, i, {_EMA.format(a=15, n='13.0::DOUBLE')} - {_EMA.format(a=1, n='27.0::DOUBLE')} AS m FROM t), m AS (SELECT symbol, list(m ORDER BY i) AS m FROM l GROUP BY symbol), macds AS (SELECT symbol, m[-1] AS macd, list_avg(m[1:9]) * pow(0.8, len(m) - 9) + coalesce(list_sum(list_transform(generate_series(10, len(m)), lambda j: m[j] * 0.2 * pow(0.8, len(m) - j))), 0) AS signal FROM m)"


@query("F04_macd", f"WITH {_MACD} SELECT symbol, round(macd, 4) AS macd, round(signal, 4) AS signal, round(macd - signal, 4) AS histogram FROM macds")
def macd(t: Tables):
    return S.macd(rows(t, _HOURS))


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, what: str) -> str:
    return f"CASE WHEN count(close) OVER {_w(n)} = {n} THEN {what} OVER {_w(n)} END"


_LATEST = f"""WITH {_MACD}, h AS (SELECT symbol, day, close, volume, round({_full(20, 'avg(close)')}, 2) AS sma20, round({_full(50, 'avg(close)')}, 2) AS sma50, round({_full(200, 'avg(close)')}, 2) AS sma200, round({_full(20, 'avg(close)')} + 2 * {_full(20, 'stddev_pop(close)')}, 2) AS upper, round({_full(20, 'avg(close)')} - 2 * {_full(20, 'stddev_pop(close)')}, 2) AS lower, round(avg(volume) OVER {_w(20)}, 0) AS average_volume FROM ({plain(_HOURS)})),
  r AS (SELECT h.*, round(macd - signal, 2) AS histogram FROM h LEFT JOIN macds USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1)"""


def _record(t: Tables):
    bars = rows(t, _HOURS)
    upper, lower = M.bollinger()
    wide = bars.select("*", *[F.round(M.moving_average(n), 2).alias(f"sma{n}") for n in (20, 50, 200)], F.round(upper, 2).alias("upper"), F.round(lower, 2).alias("lower"), F.round(F.avg("volume").over(M._frame(20)), 0).alias("average_volume"))
    last = wide.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))).where("_n = 1").drop("_n")
    lines = S.macd(bars).select("symbol", F.round("histogram", 2).alias("histogram"))
    return last.join(lines, "symbol", "left").join(M.rsi(bars), "symbol", "left")


_TWELVE = "sma50 > sma200 AS golden_cross, sma50 <= sma200 AS death_cross, close > sma20 AS above_sma20, close > sma50 AS above_sma50, close > sma200 AS above_sma200, histogram > 0 AS macd_bullish, histogram < 0 AS macd_bearish, CASE WHEN lower IS NOT NULL THEN close > upper END AS above_upper_bb, CASE WHEN upper IS NOT NULL THEN close < lower END AS below_lower_bb, CASE WHEN average_volume > 0 THEN volume > average_volume END AS volume_above_avg"
_RSI = f"d AS (SELECT symbol, day, close - lag(close) OVER (PARTITION BY symbol ORDER BY day) AS d FROM ({plain(_HOURS)})), u AS (SELECT symbol, list(greatest(d, 0) ORDER BY day) AS u, list(greatest(-d, 0) ORDER BY day) AS v FROM d WHERE d IS NOT NULL GROUP BY symbol), e AS (SELECT symbol, list_reduce(list_prepend(list_avg(u[1:14]), u[15:]), lambda a, b: a + (1/14.0::DOUBLE) * (b - a)) AS u, list_reduce(list_prepend(list_avg(v[1:14]), v[15:]), lambda a, b: a + (1/14.0::DOUBLE) * (b - a)) AS v FROM u), rs AS (SELECT symbol, round(100 * u / (u + v), 2) AS rsi FROM e)"


@query("F07_trend_signals", f"{_LATEST}, {_RSI} SELECT symbol, rsi > 70 AS rsi_overbought, rsi < 30 AS rsi_oversold, {_TWELVE} FROM r LEFT JOIN rs USING (symbol)")
def trend_signals(t: Tables):
    return _record(t).select("symbol", *[c.alias(n) for n, c in S.signals().items()])


@query("I24_band_position", f"{_LATEST} SELECT symbol, CASE WHEN close > upper THEN 'Price is above the upper Bollinger Band (potential overbought).' WHEN close < lower THEN 'Price is below the lower Bollinger Band (potential oversold).' WHEN upper <> lower THEN printf('Price is at %.0f%% of the Bollinger Band range.', (close - lower) / (upper - lower) * 100) ELSE printf('Bollinger Bands are flat at $%.2f.', upper) END AS note FROM r")
def band_position(t: Tables):
    return _record(t).select("symbol", S.band_position().alias("note"))


_EPS = "SELECT c_mktsegment AS symbol, cast(o_orderdate AS date) AS period, max(o_totalprice) / 50000 - 6 AS eps FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment, cast(o_orderdate AS date)"
_CLOSES = "SELECT c_mktsegment AS symbol, cast(o_orderdate AS date) AS day, max(o_totalprice) AS close FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY c_mktsegment, cast(o_orderdate AS date)"


@query("E20_trailing_multiples", f"WITH e AS ({plain(_EPS)}), p AS ({plain(_CLOSES)}), a AS (SELECT e.symbol, e.period, e.eps, p.close FROM e ASOF JOIN p ON p.symbol = e.symbol AND p.day <= e.period WHERE e.eps > 0) SELECT symbol, count(*) AS periods, round(arg_max(close / eps, period), 4) AS last, round(avg(close / eps), 4) AS average FROM a GROUP BY symbol HAVING count(*) >= 2")
def trailing(t: Tables):
    return S.trailing_multiples(rows(t, _EPS), rows(t, _CLOSES))


_POOL = "SELECT s_name AS symbol, s_nationkey AS grp FROM {supplier}"
_PROFILES = "SELECT s_name AS symbol, 'Co ' || s_suppkey AS name, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS market_cap FROM {supplier} WHERE s_acctbal > 0"
_REVENUES = "SELECT s_name AS symbol, sum(l_quantity) AS revenue FROM {supplier} JOIN {lineitem} ON l_suppkey = s_suppkey WHERE s_nationkey < 12 GROUP BY s_name"


@query("D19_enriched_peers", f"SELECT symbol, coalesce(name, '') AS name, market_cap, revenue FROM ({plain(_POOL)}) LEFT JOIN ({plain(_PROFILES)}) USING (symbol) LEFT JOIN ({plain(_REVENUES)}) USING (symbol)")
def enriched(t: Tables):
    return S.enriched(rows(t, _POOL), rows(t, _PROFILES), rows(t, _REVENUES))


_SELECTED = "SELECT s_nationkey AS grp, s_name AS symbol, s_suppkey = first AS subject FROM {supplier} JOIN (SELECT s_nationkey AS n, min(s_suppkey) AS first FROM {supplier} GROUP BY s_nationkey) f ON n = s_nationkey"
_METRICS = "SELECT s_name AS symbol, CASE WHEN s_acctbal > 1000 THEN s_acctbal END AS forward_pe FROM {supplier} WHERE s_acctbal > -500"
_COHORT = f"c AS (SELECT s.grp, s.symbol, s.subject, m.symbol IS NULL AS missing, m.forward_pe FROM ({plain(_SELECTED)}) s LEFT JOIN ({plain(_METRICS)}) m ON m.symbol = s.symbol), k AS (SELECT * FROM c WHERE grp IN (SELECT grp FROM c WHERE subject AND NOT missing))"


@query("D21_cohort", f"WITH {_COHORT} SELECT * FROM k")
def cohort(t: Tables):
    return S.cohort(rows(t, _SELECTED), rows(t, _METRICS))


@query("G07_cohort_order", f"WITH {_COHORT} SELECT grp, symbol, row_number() OVER (PARTITION BY grp ORDER BY subject DESC, forward_pe DESC, symbol) AS place FROM k WHERE forward_pe IS NOT NULL")
def cohort_order(t: Tables):
    return S.cohort_order(cohort(t))


_LABELS = "SELECT s_nationkey AS grp, s_name AS name, floor(s_acctbal / 500) AS value FROM {supplier}"


@query("F19_spread_labels", f"SELECT grp, name, round(max(value - k * 1.5) OVER (PARTITION BY grp ORDER BY value, name) + k * 1.5, 6) AS at FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value, name) - 1 AS k FROM ({plain(_LABELS)}))")
def spread_labels(t: Tables):
    return S.spread_labels(rows(t, _LABELS), 1.5)


_TASKS = "SELECT o_custkey AS grp, o_orderkey AS task, floor(o_totalprice / 10000) AS target, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS started FROM {orders}"


@query("G10_timeline", f"SELECT grp, task, row_number() OVER (PARTITION BY grp ORDER BY started IS NULL, started, task) AS place FROM ({plain(_TASKS)})")
def timeline(t: Tables):
    return S.timeline(rows(t, _TASKS))


@query("G11_longest_first", f"SELECT grp, task, row_number() OVER (PARTITION BY grp ORDER BY target DESC, task) AS place FROM ({plain(_TASKS)})")
def longest_first(t: Tables):
    return S.longest_first(rows(t, _TASKS))


_USES = "SELECT o_custkey AS grp, o_orderpriority AS name, o_orderkey AS ord FROM {orders}"


@query("G12_recent_first", f"SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY max(ord) DESC, name) AS place FROM ({plain(_USES)}) GROUP BY grp, name")
def recent_first(t: Tables):
    return S.recent_first(rows(t, _USES))


_TARGETS = "SELECT p_partkey AS id, p_retailprice AS price, p_retailprice * (1 + (p_size - 20) / 100.0) AS target FROM {part}"


@query("I22_target_upside", f"SELECT id, round((target / price - 1) * 100, 2) AS upside FROM ({plain(_TARGETS)})")
def target_upside(t: Tables):
    return rows(t, _TARGETS).select("id", F.round((F.try_divide(F.col("target").cast("double"), F.col("price")) - 1) * 100, 2).alias("upside"))
