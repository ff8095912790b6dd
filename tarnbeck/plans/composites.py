"""Composite queries: status, shown sources, exhibits' data, and rows of other operators that stand alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnbeck.operators import harvest as H
from tarnbeck.operators import ledger as L
from tarnbeck.operators import provenance as P
from tarnbeck.operators import statements as S
from tarnbeck.plans.base import NOW, ORACLE_SQL, Tables, query
from tarnbeck.plans.gates import dirty_sections
from tarnbeck.plans.reports import plain, rows

_WANTED = "SELECT c_custkey AS id FROM {customer}"
_LAYERS = [f"SELECT DISTINCT o_custkey AS id FROM {{orders}} WHERE o_orderpriority = '{p}' AND o_orderstatus = 'P'" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")]
_FIRST = " ".join(f"WHEN id IN ({plain(sql)}) THEN {i}" for i, sql in enumerate(_LAYERS))


@query("A05_any_artifact", f"SELECT id, CASE {_FIRST} END AS layer FROM ({plain(_WANTED)})")
def any_artifact(t: Tables):
    return H.resolved(rows(t, _WANTED), *[rows(t, sql) for sql in _LAYERS])


_FILES = "SELECT doc_id AS id, CASE lang WHEN 'de' THEN '00_manifest.md' ELSE source || '_' || doc_id || '.md' END AS name, source IN ('src1', 'src9') AS is_archived FROM {documents}"


@query("A06_current_sources", f"SELECT id, name FROM ({plain(_FILES)}) WHERE NOT is_archived AND name <> '00_manifest.md'")
def current_sources(t: Tables):
    return rows(t, _FILES).where(~F.col("is_archived") & (F.col("name") != "00_manifest.md")).select("id", "name")


_JSON = "SELECT p_partkey AS id, CASE WHEN p_size < 15 THEN 'structured/' ELSE 'derived/' END || p_brand || '/' || p_partkey || CASE WHEN p_size > 40 THEN '.txt' ELSE '.json' END AS path FROM {part}"


@query("A07_durable_json", f"SELECT id, starts_with(path, 'structured/') AS bronze FROM ({plain(_JSON)}) WHERE path LIKE '%.json'")
def durable_json(t: Tables):
    return rows(t, _JSON).where(F.endswith(F.col("path"), F.lit(".json"))).select("id", F.startswith(F.col("path"), F.lit("structured/")).alias("bronze"))


_LOGS = "SELECT o_orderpriority AS purpose, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS section, o_orderkey AS ord, o_orderkey AS value FROM {orders} WHERE o_totalprice > 200000"
_SPENT = "SELECT o_orderpriority AS purpose, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS section, o_orderkey AS ord, o_custkey AS value FROM {orders} WHERE o_totalprice < 90000"


@query("H06_leftovers", f"WITH a AS (SELECT purpose, section, count(*) AS n FROM ({plain(_LOGS)}) GROUP BY ALL), b AS (SELECT purpose, section, count(*) AS n FROM ({plain(_SPENT)}) GROUP BY ALL) SELECT coalesce(a.purpose, b.purpose) AS purpose, coalesce(a.section, b.section) AS section, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS unattributed, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS unspent FROM a FULL JOIN b ON a.purpose = b.purpose AND a.section IS NOT DISTINCT FROM b.section")
def leftovers(t: Tables):
    paired = L.one_for_one(rows(t, _LOGS), rows(t, _SPENT), ["purpose", "section"])
    return paired.groupBy("purpose", "section").agg(F.count(F.when(F.col("left_value").isNull(), 1)).alias("unattributed"), F.count(F.when(F.col("right_value").isNull(), 1)).alias("unspent"))


_STATE = f"SELECT user_id AS kind, max(ts) AS fetched, count(*) > 9 AS on_earnings, max(value) > 150 AS missing FROM {{events}} GROUP BY user_id"


@query("J02_event_staleness", f"SELECT kind, CASE WHEN missing THEN true WHEN on_earnings THEN cast(fetched AS DATE) < date '2024-01-29' ELSE epoch(timestamp '{NOW}') - epoch(date_trunc('second', fetched)) > 86400 * 7 END AS stale FROM ({plain(_STATE)})")
def event_staleness(t: Tables):
    due = P.stale(F.lit(NOW).cast("timestamp"), F.lit(None).cast("int"), F.col("fetched"), F.col("on_earnings"), F.lit("2024-01-29").cast("date"), F.col("missing"))
    return rows(t, _STATE).select("kind", due.alias("stale"))


@query("L01_status", f"SELECT kind FROM (SELECT kind, CASE WHEN missing THEN true WHEN on_earnings THEN cast(fetched AS DATE) < date '2024-01-29' ELSE epoch(timestamp '{NOW}') - epoch(date_trunc('second', fetched)) > 86400 * 7 END AS stale FROM ({plain(_STATE)})) WHERE stale")
def status(t: Tables):
    return event_staleness(t).where("stale").select("kind")


@query("L01_status_report", f"WITH s AS ({ORACLE_SQL['L01_status']}), d AS ({ORACLE_SQL['J06_dirty_sections']}) SELECT 'stale kind' AS what, cast(kind AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS place FROM s UNION ALL SELECT 'dirty section', section, place FROM d")
def status_report(t: Tables):
    """What is to be done: stale kinds, then the report's dirty sections in their order."""
    stale = event_staleness(t).where("stale").select(F.lit("stale kind").alias("what"), F.col("kind").cast("string").alias("name"), F.lit(None).cast("bigint").alias("place"))
    return stale.union(dirty_sections(t).select(F.lit("dirty section"), "section", F.col("place").cast("bigint")))


_SHOWN = "SELECT doc_id AS id, 'current' AS layer, text AS body FROM {documents} WHERE lang = 'en' UNION ALL SELECT doc_id, 'archived', text FROM {documents} WHERE source <> 'src7'"


@query("L02_show", f"SELECT id, min(layer) = 'archived' AS archived, length(arg_max(body, layer)) AS chars FROM ({plain(_SHOWN)}) GROUP BY id")
def show(t: Tables):
    """A source's current version, or else its archived one, and which of both it is."""
    shown = rows(t, _SHOWN).groupBy("id").agg(F.min("layer").alias("first"), F.max_by("body", "layer").alias("body"))
    return shown.select("id", (F.col("first") == "archived").alias("archived"), F.length("body").cast("long").alias("chars"))


_FAIR = "SELECT p_partkey AS id, p_retailprice AS price, CASE WHEN p_size > 5 THEN p_retailprice * (1 + (p_size - 25) / 200.0) END AS fair FROM {part}"


@query("I23_implied_return", f"SELECT id, round((fair / price - 1) * 100, 2) AS implied FROM ({plain(_FAIR)})")
def implied_return(t: Tables):
    return rows(t, _FAIR).select("id", S.implied_return(F.col("fair").cast("double"), F.col("price")).alias("implied"))


_ALIASES = "SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS a, max(CASE WHEN l_returnflag = 'A' THEN l_tax END) AS b, max(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS c FROM {lineitem} GROUP BY l_orderkey"


@query("I17_alias_items", f"SELECT id, coalesce(a, b, c) AS item FROM ({plain(_ALIASES)})")
def alias_items(t: Tables):
    return rows(t, _ALIASES).select("id", F.coalesce("a", "b", "c").alias("item"))


_PEERS = "SELECT c_nationkey AS grp, c_name AS symbol, c_acctbal AS growth, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal / 10 END AS margin, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS cap FROM {customer}"


@query("L13_peer_scatter", f"WITH p AS (SELECT * FROM ({plain(_PEERS)}) WHERE growth IS NOT NULL AND margin IS NOT NULL) SELECT grp, symbol, round(14 + 26 * sqrt(coalesce(cap, 0) / coalesce(nullif(max(coalesce(cap, 0)) OVER (PARTITION BY grp), 0), 1)), 4) AS size FROM p")
def peer_scatter(t: Tables):
    """Marker sizes by market value; companies without growth or margin aren't plotted."""
    shown = rows(t, _PEERS).where("growth is not null and margin is not null").withColumn("cap", F.coalesce("cap", F.lit(0.0)))
    most = F.coalesce(F.nullif(F.max("cap").over(Window.partitionBy("grp")), F.lit(0.0)), F.lit(1.0))
    return shown.withColumn("most", most).select("grp", "symbol", F.round(14 + 26 * F.sqrt(F.col("cap") / F.col("most")), 4).alias("size"))


_YEARS = "SELECT c_mktsegment AS symbol, year(o_orderdate) AS period, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS double) AS revenue FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment, year(o_orderdate)"


@query("L12_revenue_exhibit", f"WITH y AS ({plain(_YEARS)}), n AS (SELECT symbol FROM y GROUP BY symbol HAVING count(*) >= 2) SELECT symbol, period, round(revenue, 2) AS revenue, round((revenue / nullif(lag(revenue) OVER (PARTITION BY symbol ORDER BY period), 0) - 1) * 100, 4) AS growth FROM y WHERE symbol IN (SELECT symbol FROM n)")
def revenue_exhibit(t: Tables):
    """Revenue and its growth by year, of symbols with two years or more."""
    years = rows(t, _YEARS)
    enough = years.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("symbol")
    before = F.lag("revenue").over(Window.partitionBy("symbol").orderBy("period"))
    return years.join(enough, "symbol", "left_semi").select("symbol", "period", F.round("revenue", 2).alias("revenue"), F.round((F.try_divide(F.col("revenue"), before) - 1) * 100, 4).alias("growth"))


_CALENDAR = "SELECT c_custkey AS symbol, CASE WHEN c_acctbal > 3000 THEN date '2024-02-10' END AS earnings, CASE WHEN c_acctbal > 0 THEN date '2024-03-01' END AS dividend, CASE WHEN c_mktsegment = 'BUILDING' THEN date '2024-02-05' END AS exdividend FROM {customer}"


@query("I37_forward_events", f"SELECT symbol, day, label FROM (SELECT symbol, earnings AS day, 'Earnings' AS label FROM ({plain(_CALENDAR)}) UNION ALL SELECT symbol, dividend, 'Dividend' FROM ({plain(_CALENDAR)}) UNION ALL SELECT symbol, exdividend, 'Ex-dividend' FROM ({plain(_CALENDAR)})) WHERE day IS NOT NULL")
def forward_events(t: Tables):
    """The dated events of a calendar record, one row each."""
    kinds = F.array(*[F.struct(F.col(c).alias("day"), F.lit(n).alias("label")) for c, n in (("earnings", "Earnings"), ("dividend", "Dividend"), ("exdividend", "Ex-dividend"))])
    return rows(t, _CALENDAR).select("symbol", F.inline(kinds)).where("day is not null")


_PAGES = "SELECT user_id AS id, max(ts) AS fetched FROM {events} GROUP BY user_id"


@query("J10_page_freshness", f"SELECT id, fetched >= timestamp '2024-02-20 00:00:00' - INTERVAL 30 DAY AS fresh FROM ({plain(_PAGES)})")
def page_freshness(t: Tables):
    from tarnbeck.operators.checks import fresh

    return rows(t, _PAGES).select("id", fresh(F.col("fetched"), F.lit("2024-02-20 00:00:00").cast("timestamp_ntz")).alias("fresh"))
