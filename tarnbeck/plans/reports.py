"""Queries over report texts, verdicts, runs and statements.

Their inputs are SQL that both engines read, with the tables' names in braces; the operator runs on the result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import checks as C
from tarnbeck.operators import market as M
from tarnbeck.operators import reports as R
from tarnbeck.operators import statements as S
from tarnbeck.plans.base import BARS, Tables, query


def rows(t: Tables, sql: str) -> DataFrame:
    return t.spark.sql(sql, **{n: t(n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


DOCS = "SELECT doc_id AS id, source AS section, text AS body FROM {documents}"
_PROSE = "array_to_string(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(ltrim(x), '^[|#>]')), chr(10))"


@query("C20_longest_sentence", f"""WITH d AS ({plain(DOCS)}), s AS (SELECT id, string_split(regexp_replace({_PROSE}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM d),
    e AS (SELECT id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS place FROM s), w AS (SELECT id, place, cast(len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM e)
    SELECT id, arg_max(place, (words, -place)) AS place, max(words) AS words FROM w GROUP BY id""")
def longest_sentence(t: Tables):
    return R.longest_sentence(rows(t, DOCS))


_SHOWN = "SELECT doc_id AS id, '![a](img' || (doc_id % 3) || '.png) text ![b](img' || (doc_id % 2) || '.png)' AS body FROM {documents}"


@query("C34_repeated_exhibits", f"SELECT id, image, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)\\s]+)', 1)) AS image FROM ({plain(_SHOWN)})) GROUP BY id, image HAVING count(*) > 1")
def repeated_exhibits(t: Tables):
    return R.repeated_exhibits(rows(t, _SHOWN))


_MARKED = "SELECT doc_id AS id, 'x [^d' || (doc_id % 7) || '] y [^' || source || '] z [^d' || (doc_id % 5) || '] [^' || lang || '] [^q' || (doc_id % 2) || '] [^last]' AS body FROM {documents}"


@query("C35_dangling_markers", f"WITH m AS (SELECT id, regexp_extract_all(body, '\\[\\^[^\\]\\s]+\\]') AS m FROM ({plain(_MARKED)})) SELECT id, array_to_string(list_slice(list_filter(m, lambda x, i: list_position(m, x) = i), 1, 5), ' ') AS markers FROM m")
def dangling(t: Tables):
    return rows(t, _MARKED).select("id", F.array_join(R.dangling(F.col("body")), " ").alias("markers"))


@query("I08_cell_escape", "SELECT page_id, md5(replace(html, '|', chr(92) || '|')) AS cell FROM pages")
def cells(t: Tables):
    return t("pages").select("page_id", F.md5(R.cell(F.col("html"))).alias("cell"))


@query("I35_truncation", f"WITH d AS ({plain(DOCS)}) SELECT id, md5(substring(array_to_string(list_slice(string_split(body, chr(10)), 1, 40), chr(10)), 1, 3000)) AS cut FROM d")
def truncated(t: Tables):
    return rows(t, DOCS).select("id", F.md5(T.truncated(F.col("body"))).alias("cut"))


_TABLES = "SELECT c_custkey AS id, '| name | a | b |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || c_name || ' | ' || c_custkey || ' | n/a |' || chr(10) || '| ' || c_mktsegment || ' | $' || (c_custkey % 97) || '% | ' || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '+1.5x' END || ' |' AS body FROM {customer}"


@query("E16_numeric_columns", "SELECT c_custkey AS id, cast(col AS BIGINT) AS col, CASE col WHEN 0 THEN false WHEN 1 THEN true ELSE c_custkey % 2 <> 0 END AS numeric FROM customer, (VALUES (0), (1), (2)) v(col)")
def numeric_columns(t: Tables):
    return R.numeric_columns(rows(t, _TABLES))


_HITS = "SELECT l_orderkey AS id, l_partkey % 2000 AS pos, cast(2000 AS bigint) AS size FROM {lineitem}"


@query("F18_merged_spans", f"""WITH h AS ({plain(_HITS)}), s AS (SELECT id, greatest(pos - 150, 0) AS a, least(pos + 150, size) AS b FROM h),
    r AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
    i AS (SELECT *, sum(CASE WHEN a <= p THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r)
    SELECT id, min(a) AS start, max(b) AS "end" FROM i GROUP BY id, k""")
def merged_spans(t: Tables):
    return R.merged_spans(rows(t, _HITS), 150)


@query("D06_page_not_indexed", "SELECT n_name AS name FROM nation WHERE NOT contains((SELECT string_agg(n_name, ' ') FROM nation WHERE n_nationkey % 2 = 0), n_name)")
def unindexed(t: Tables):
    n = t("nation")
    index = n.where("n_nationkey % 2 = 0").agg(F.array_join(F.collect_list("n_name"), " ").alias("text"))  # one row a nation
    return R.unindexed(n.select(F.col("n_name").alias("name")), index)


_OWNERS = [("the", "src1"), ("license", "src2"), ("copyright", "src0")]


@query("C26_section_ownership", f"WITH o(phrase, owner) AS (VALUES {', '.join(map(str, _OWNERS))}), d AS ({plain(DOCS)}), w AS (SELECT DISTINCT id, section, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS phrase FROM d) SELECT id, phrase, owner FROM w JOIN o USING (phrase) WHERE section <> owner")
def ownership(t: Tables):
    return R.owned_elsewhere(rows(t, DOCS), t.spark.createDataFrame(_OWNERS, "phrase string, section string"))


_CITED = "SELECT p.page_id AS id, p.url AS a, coalesce(q.url, 'none') AS b FROM {pages} p LEFT JOIN (SELECT page_id + 1 AS page_id, min(url) AS url FROM {pages} GROUP BY page_id) q ON q.page_id = p.page_id"
_CURRENT = "SELECT url, page_id AS source FROM {pages} WHERE html LIKE '%<article%'"


@query("D17_origins", f"WITH c AS ({plain(_CITED)}), s AS (SELECT url, min(source) AS source FROM ({plain(_CURRENT)}) GROUP BY url) SELECT c.id, concat_ws(',', x.source, y.source) AS sources FROM c LEFT JOIN s x ON x.url = c.b LEFT JOIN s y ON y.url = c.a WHERE x.source IS NOT NULL OR y.source IS NOT NULL")
def origins(t: Tables):
    carriers = rows(t, _CITED).select("id", F.array("b", "a").alias("urls"))
    out = R.origins(carriers, rows(t, _CURRENT))
    return out.select("id", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


_CHOSEN = "SELECT p_partkey AS ord, 'c' || (p_partkey * 7 % 500) AS name, p_brand AS section FROM {part}"
_DRAWN = "SELECT DISTINCT 'c' || p_size AS name FROM {part}"


@query("D26_chart_choice", f"""WITH c AS ({plain(_CHOSEN)}), d AS ({plain(_DRAWN)}), r AS (SELECT ord, name, section, CASE WHEN name NOT IN (SELECT name FROM d) THEN 'no image' WHEN section NOT IN ('Brand#11', 'Brand#22', 'Brand#33') THEN 'unknown section' WHEN name IN ('c1', 'c2') THEN 'dashboard chart' END AS reason FROM c)
    SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY section, reason IS NULL ORDER BY ord, name) END AS number FROM r""")
def chart_choice(t: Tables):
    return R.chart_choice(rows(t, _CHOSEN), rows(t, _DRAWN), ["Brand#11", "Brand#22", "Brand#33"], ["c1", "c2"])


_DATES = "SELECT o_orderpriority AS symbol, cast(o_orderdate AS date) AS day FROM {orders}"


@query("F15_next_date", f"SELECT symbol, min(CASE WHEN day >= date '1995-06-01' THEN day END) AS next, max(CASE WHEN day <= date '1995-06-01' THEN day END) AS last FROM ({plain(_DATES)}) GROUP BY symbol")
def next_date(t: Tables):
    return R.next_date(rows(t, _DATES), "day", "1995-06-01")


_CARDS = "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS rating, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 5 END AS price, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 7) * 0.2 END AS probability FROM {orders}"


@query("C27_verdict_shape", f"""WITH c AS ({plain(_CARDS)}) SELECT id, 'rating missing' AS problem FROM c WHERE rating IS NULL UNION ALL SELECT id, 'price missing' FROM c WHERE price IS NULL UNION ALL SELECT id, 'price not positive' FROM c WHERE price <= 0
    UNION ALL SELECT id, 'probability missing' FROM c WHERE probability IS NULL UNION ALL SELECT id, 'probability out of range' FROM c WHERE probability < 0 OR probability > 1""")
def verdict_shape(t: Tables):
    return C.verdict_findings(rows(t, _CARDS), "id")


_SCENARIOS = "SELECT l_orderkey AS card, CASE WHEN l_linenumber % 4 <> 0 THEN 0.25e0 * (l_partkey % 4) END AS probability FROM {lineitem}"


@query("C28_scenario_sums", f"SELECT card, round(sum(coalesce(probability, 0)), 6) AS total FROM ({plain(_SCENARIOS)}) GROUP BY card HAVING abs(total - 1) > 0.01")
def scenario_sums(t: Tables):
    return C.incoherent(rows(t, _SCENARIOS), "card")


@query("C29_pillars", f"""WITH d AS ({plain(DOCS)}), p AS (SELECT id, coalesce(string_split(body, chr(10))[1], '') AS claim, body AS support FROM d), q AS (SELECT id, NOT regexp_matches(claim, '[0-9]') AS a, len(list_filter(regexp_split_to_array(claim, '\\s+'), lambda w: w <> '')) > 40 AS b, len(regexp_extract_all(support, '[.!?](?:\\s|$)')) NOT BETWEEN 3 AND 5 AS c FROM p)
    SELECT id, 'claim without number' AS problem FROM q WHERE a UNION ALL SELECT id, 'claim too long' FROM q WHERE b UNION ALL SELECT id, 'support length' FROM q WHERE c""")
def pillars(t: Tables):
    claim = F.coalesce(F.get(F.split("body", "\n"), F.lit(0)), F.lit(""))
    return C.findings(rows(t, DOCS), ["id"], C.pillar_problems(claim, F.col("body")))


_RUNS = "SELECT o_custkey AS run, count(*) * 9 AS agents, sum(o_orderkey % 1000) * 1000 AS tokens, max(o_orderkey % 100) AS minutes FROM {orders} GROUP BY o_custkey"


@query("C30_budgets", f"WITH r AS ({plain(_RUNS)}) SELECT run, 'agents' AS problem FROM r WHERE agents > 100 UNION ALL SELECT run, 'tokens' FROM r WHERE tokens > 6000000 UNION ALL SELECT run, 'minutes' FROM r WHERE minutes > 60")
def budgets(t: Tables):
    return C.over_budget(rows(t, _RUNS), "run")


_STAMPS = "SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN ts END AS fetched FROM {events}"


@query("C31_freshness", f"SELECT id, coalesce(fetched >= timestamp '2024-02-10 12:00:00' - INTERVAL 30 DAY, false) AS fresh FROM ({plain(_STAMPS)})")
def freshness(t: Tables):
    return rows(t, _STAMPS).select("id", C.fresh(F.col("fetched"), F.lit("2024-02-10 12:00:00").cast("timestamp")).alias("fresh"))


_FORMS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '10-K/A' WHEN o_orderkey % 3 = 1 THEN '10-K' END AS form FROM {orders}"


@query("C32_amendments", f"SELECT id, form LIKE '%/A' AS amended FROM ({plain(_FORMS)})")
def amendments(t: Tables):
    return rows(t, _FORMS).select("id", C.amendment(F.col("form")).alias("amended"))


_IPS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN '::ffff:10.1.' || (c_custkey % 256) || '.3' WHEN c_custkey % 19 = 0 THEN '169.254.169.' || (250 + c_custkey % 6) WHEN c_custkey % 23 = 0 THEN CASE c_nationkey % 10 WHEN 0 THEN '::1' WHEN 1 THEN '::' WHEN 2 THEN 'fd00:ec2::254' WHEN 3 THEN 'fe80::1' WHEN 4 THEN 'febf:0::2' WHEN 5 THEN 'ff02::1' WHEN 6 THEN 'fc00::a:b' WHEN 7 THEN '2001:db8:0::1' WHEN 8 THEN '4000::1' ELSE '2606:4700::1111' END
    WHEN c_custkey % 29 = 0 THEN '0.0.0.' || (c_custkey % 2) WHEN c_custkey % 3 = 0 THEN '172.' || (c_custkey % 40) || '.0.' || (c_custkey % 300) ELSE (c_custkey % 260) || '.168.0.1' END AS ip FROM {customer}"""


@query("C13_address_kind", f"""WITH s AS (SELECT id, string_split(replace(ip, '::ffff:', ''), '.') AS p, ip FROM ({plain(_IPS)})), n AS (SELECT id, ip, list_transform(p, lambda x: try_cast(x AS BIGINT)) AS p FROM s)
    SELECT id, CASE WHEN ip = '::1' THEN 'loopback' WHEN ip = '::' THEN 'unspecified' WHEN ip = 'fd00:ec2::254' THEN 'metadata' WHEN ip LIKE 'fe8%' OR ip LIKE 'feb%' THEN 'link_local' WHEN ip LIKE 'ff%' THEN 'multicast' WHEN ip LIKE 'fc%' OR ip LIKE 'fd%' OR ip LIKE '2001:db8:%' THEN 'private' WHEN ip LIKE '4%:%' THEN 'reserved' WHEN ip LIKE '26%:%' THEN 'public' WHEN len(p) <> 4 OR list_contains(list_transform(p, lambda x: x IS NULL OR x > 255), true) THEN 'invalid' WHEN p = [169, 254, 169, 254] THEN 'metadata' WHEN p = [0, 0, 0, 0] THEN 'unspecified' WHEN p[1] = 127 THEN 'loopback'
      WHEN p[1] = 169 AND p[2] = 254 THEN 'link_local' WHEN p[1] BETWEEN 224 AND 239 THEN 'multicast' WHEN p[1] >= 240 THEN 'reserved' WHEN p[1] = 10 OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168) OR p[1] = 0 THEN 'private' ELSE 'public' END AS kind FROM n""")
def address_kind(t: Tables):
    return rows(t, _IPS).select("id", C.address_kind(F.col("ip")).alias("kind"))


_PEERS = "SELECT s_nationkey AS peer, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS pe, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS ps FROM {supplier}"


@query("C33_mostly_empty", f"SELECT peer, cast(sum((pe IS NULL)::INT + (ps IS NULL)::INT) AS BIGINT) AS empty, count(*) * 2 AS cells FROM ({plain(_PEERS)}) GROUP BY peer HAVING empty * 2 > cells")
def mostly_empty(t: Tables):
    return C.mostly_empty(rows(t, _PEERS), "peer", "pe", "ps")


_SCORES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 100) / 100e0 END AS result, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 3 % 100) / 100e0 END AS baseline FROM {customer}"


@query("E07_regression", f"SELECT id, coalesce(round(baseline - result, 9) > 0.02, true) AS regressed FROM ({plain(_SCORES)})")
def regression(t: Tables):
    return rows(t, _SCORES).select("id", C.regressed(F.col("result"), F.col("baseline")).alias("regressed"))


_LOGS = "SELECT event_type AS purpose, user_id % 10 AS minutes FROM {events} WHERE event_type <> 'click'"
_STATS = "SELECT event_type AS purpose, CASE WHEN event_id % 4 <> 0 THEN event_id END AS tokens FROM {events} WHERE event_type <> 'view'"


@query("E05_cost_by_purpose", f"""WITH a AS (SELECT purpose, cast(sum(minutes) AS BIGINT) AS minutes FROM ({plain(_LOGS)}) GROUP BY purpose), b AS (SELECT purpose, count(*) AS agents, cast(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM ({plain(_STATS)}) GROUP BY purpose)
    SELECT row_number() OVER (ORDER BY CASE purpose WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, purpose) AS place, purpose, coalesce(agents, 0) AS agents, coalesce(minutes, 0) AS minutes, coalesce(tokens, 0) AS tokens FROM a FULL JOIN b USING (purpose)""")
def cost_by_purpose(t: Tables):
    return C.cost_by_purpose(rows(t, _LOGS), rows(t, _STATS), ["view", "purchase"])


_NAMES = "SELECT o_custkey AS ticker, cast(cast(o_orderdate AS date) AS varchar(10)) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_' || (o_orderkey % 30) END AS run, o_orderstatus = 'F' AS done FROM {orders}"


@query("G09_run_order", f"SELECT ticker, run, row_number() OVER (PARTITION BY ticker ORDER BY substring(run, 1, 10), coalesce(try_cast(regexp_extract(run, '_(\\d+)$', 1) AS INTEGER), 1), run) AS place FROM (SELECT DISTINCT ticker, run FROM ({plain(_NAMES)}))")
def run_order(t: Tables):
    w = Window.partitionBy("ticker").orderBy(*C.run_order(F.col("run")))
    return rows(t, _NAMES).select("ticker", "run").distinct().withColumn("place", F.row_number().over(w).cast("long"))


@query("J12_current_run", f"SELECT ticker, arg_max(run, (substring(run, 1, 10), coalesce(try_cast(regexp_extract(run, '_(\\d+)$', 1) AS INTEGER), 1), run)) FILTER (NOT done) AS run FROM ({plain(_NAMES)}) GROUP BY ticker")
def current_run(t: Tables):
    return C.current_run(rows(t, _NAMES), "ticker")


@query("H05_state_delta", """WITH b AS (SELECT c_custkey AS key, c_nationkey AS value FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey AS key, c_nationkey + cast(c_custkey % 3 = 0 AS INT) AS value FROM customer), s AS (SELECT c_custkey AS key, c_nationkey + 100 AS value FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(s.key, c.key) AS key, CASE WHEN c.key IS NOT NULL THEN c.value ELSE s.value END AS value FROM s FULL JOIN (SELECT a.key, a.value FROM a LEFT JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value) c ON c.key = s.key""")
def state_delta(t: Tables):
    c = lambda sql: rows(t, f"SELECT c_custkey AS key, {sql}")
    return C.state_delta(c("c_nationkey + 100 AS value FROM {customer} WHERE c_custkey % 2 = 0"), c("c_nationkey AS value FROM {customer} WHERE c_custkey % 5 <> 0"), c("c_nationkey + cast(c_custkey % 3 = 0 AS int) AS value FROM {customer}"))


_NEEDS = [("prices", "state"), ("technical", "prices"), ("peers", "financials"), ("report", "technical"), ("report", "peers"), ("financials", "profile")]


@query("J09_dependency_waves", "SELECT * FROM (VALUES ('prices', 0::BIGINT), ('profile', 0), ('technical', 1), ('financials', 1), ('peers', 2), ('report', 3)) v(node, wave)")
def dependency_waves(t: Tables):
    edges = t.spark.createDataFrame(_NEEDS, "node string, needs string")
    wanted = t.spark.createDataFrame([(n,) for n in ("prices", "profile", "technical", "financials", "peers", "report")], "node string")
    return C.levels(edges, wanted)


_ITEMS = "SELECT o_orderkey AS id, cast(1000 + o_orderkey % 900 AS bigint) AS revenue, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 400 END AS cost, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 800 END AS gross, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 100 END AS opex, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 60 END AS operating FROM {orders}"


@query("I18_line_items", f"""WITH g AS (SELECT *, coalesce(gross, revenue - cost) AS g FROM ({plain(_ITEMS)}))
    SELECT id, g AS gross, coalesce(cost, revenue - gross) AS cost, coalesce(opex, g - operating) AS opex, coalesce(operating, g - opex) AS operating FROM g""")
def line_items(t: Tables):
    return rows(t, _ITEMS).select("id", *[c.alias(n) for n, c in S.filled_items().items()])


_FIGURES = "SELECT c_custkey AS id, cast(c_custkey * 37 % 1000 AS bigint) AS cap, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 90 END AS debt, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 50 END AS cash, CASE WHEN c_custkey % 9 <> 0 THEN cast(c_custkey * 37 % 1000 + c_custkey % 60 AS bigint) END AS reported FROM {customer}"


@query("I20_ev_reconciliation", f"WITH f AS (SELECT *, cap + coalesce(debt, 0) - coalesce(cash, 0) AS ev FROM ({plain(_FIGURES)})) SELECT id, ev, CASE WHEN ev = 0 THEN false ELSE coalesce(abs(reported / ev - 1) > 0.02, false) END AS diverges FROM f")
def ev_reconciliation(t: Tables):
    ev = S.enterprise_value(F.col("cap"), F.col("debt"), F.col("cash"))
    return rows(t, _FIGURES).select("id", ev.alias("ev"), S.diverges(ev, F.col("reported")).alias("diverges"))


@query("I21_revisions", f"SELECT id, CASE WHEN debt <> 0 THEN round((cap - debt) / abs(debt) * 100, 1) END AS revision, CASE WHEN cash <> 0 THEN round((cap / cash - 1) * 100, 2) END AS implied FROM ({plain(_FIGURES)})")
def revisions(t: Tables):
    return rows(t, _FIGURES).select("id", S.change(F.col("cap"), F.col("debt")).alias("revision"), S.implied_return(F.col("cap"), F.col("cash")).alias("implied"))


_PERIODS = "SELECT l_suppkey AS symbol, l_orderkey AS period, CASE WHEN l_quantity > 10 THEN l_quantity END AS value FROM {lineitem} WHERE l_linenumber = 1"


@query("E11_coverage", f"SELECT symbol, round(count(value) / count(*), 2) AS coverage FROM ({plain(_PERIODS)}) GROUP BY symbol")
def coverage(t: Tables):
    return S.coverage(rows(t, _PERIODS), "symbol", "value")


@query("I36_gaps", f"SELECT symbol, string_agg(cast(period AS VARCHAR), ', ' ORDER BY period) AS gaps FROM ({plain(_PERIODS)}) WHERE value IS NULL GROUP BY symbol")
def gaps(t: Tables):
    return S.gaps(rows(t, _PERIODS), "symbol", "value")


_SERIES = "SELECT event_type AS series, CASE WHEN event_id % 11 = 0 THEN '2024' ELSE cast(cast(ts AS date) AS varchar(10)) END AS date, CASE WHEN event_id % 7 = 0 THEN '.' ELSE cast(user_id AS varchar(20)) END AS value FROM {events}"


@query("I26_observations", f"SELECT series, date, try_cast(value AS DOUBLE) AS value FROM ({plain(_SERIES)}) WHERE length(date) = 10 AND date >= '2024-01-05' AND try_cast(value AS DOUBLE) IS NOT NULL")
def observations(t: Tables):
    return S.observations(rows(t, _SERIES), "2024-01-05")


_RATES = "SELECT event_type AS series, cast(ts AS varchar(40)) AS date, max(value) AS value FROM {events} GROUP BY event_type, ts"


@query("I25_rate_spread", "SELECT round(arg_max(value, (ts, value)) FILTER (event_type = 'view') - arg_max(value, (ts, value)) FILTER (event_type = 'click'), 4) AS spread FROM events")
def rate_spread(t: Tables):
    return S.latest_spread(rows(t, _RATES), "view", "click")


_FLOWS = "SELECT l_orderkey AS statement, 'n' || (l_linenumber % 2) AS source, 'n' || (1 + l_partkey % 60) AS target, cast(sum(l_suppkey) AS bigint) AS value, cast(8000 AS bigint) AS revenue FROM {lineitem} GROUP BY 1, 2, 3"


@query("E15_fold_sinks", f"""WITH e AS ({plain(_FLOWS)}), m AS (SELECT *, value < revenue * 0.0025 AND NOT EXISTS (SELECT 1 FROM e s WHERE s.statement = e.statement AND s.source = e.target) AS small FROM e), n AS (SELECT *, count(*) FILTER (small) OVER (PARTITION BY statement, source) AS k FROM m)
    SELECT statement, source, CASE WHEN small AND k >= 2 THEN 'Other' ELSE target END AS target, cast(sum(value) AS BIGINT) AS value FROM n GROUP BY ALL""")
def fold_sinks(t: Tables):
    return S.fold_sinks(rows(t, _FLOWS))


_NODES = "SELECT l_orderkey AS statement, l_linenumber % 2 AS level, 'n' || l_linenumber AS node, l_quantity AS value FROM {lineitem}"


@query("F20_node_layout", f"SELECT statement, level, node, round(coalesce(sum(value + 0.5e0) OVER (PARTITION BY statement, level ORDER BY value DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS top FROM ({plain(_NODES)})")
def node_layout(t: Tables):
    return S.stacked(rows(t, _NODES), 0.5)


_WEEK = "cast(day + cast((12 - isodow(day)) % 7 AS INTEGER) AS DATE)"


@query("F08_weekly_averages", f"WITH {BARS}, k AS (SELECT symbol, {_WEEK} AS week, arg_max(close, day) AS close FROM bars GROUP BY ALL) SELECT symbol, week, round(CASE WHEN count(close) OVER w = 13 THEN avg(close) OVER w END, 4) AS ma13 FROM k WINDOW w AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)")
def weekly_averages(t: Tables):
    weeks = M.weekly(M.daily_bars(t.ticks())).withColumnRenamed("week", "day")
    return weeks.select("symbol", F.col("day").alias("week"), F.round(M.moving_average(13), 4).alias("ma13"))


_FUNDS = "SELECT o_custkey AS grp, o_orderkey AS fund, o_totalprice AS weight, o_orderkey % 200 AS holdings FROM {orders}"


@query("G06_funds_in_band", f"SELECT grp, fund FROM ({plain(_FUNDS)}) WHERE holdings BETWEEN 20 AND 150 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY weight DESC, fund) <= 5")
def funds_in_band(t: Tables):
    w = Window.partitionBy("grp").orderBy(F.desc("weight"), "fund")
    return rows(t, _FUNDS).where("holdings between 20 and 150").withColumn("_r", F.row_number().over(w)).where("_r <= 5").select("grp", "fund")


@query("H04_common_weeks", f"WITH {BARS}, k AS (SELECT DISTINCT symbol, {_WEEK} AS week FROM bars) SELECT week FROM k WHERE symbol = 'view' INTERSECT SELECT week FROM k WHERE symbol = 'click'")
def common_weeks(t: Tables):
    weeks = M.weekly(M.daily_bars(t.ticks())).select("symbol", "week")
    return weeks.where("symbol = 'view'").select("week").intersect(weeks.where("symbol = 'click'").select("week"))


@query("D08_replaced_sources", "SELECT DISTINCT o_custkey AS consumer, o_orderkey AS ref FROM orders WHERE o_orderkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def replaced_sources(t: Tables):
    replaced = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("ref"))
    return t("orders").select(F.col("o_custkey").alias("consumer"), F.col("o_orderkey").alias("ref")).join(replaced, "ref", "left_semi").distinct()


@query("I31_word_target", "SELECT p_partkey, cast(round_even(p_size * 37 * 0.5, 0) AS BIGINT) AS target FROM part")
def word_target(t: Tables):
    return t("part").select("p_partkey", F.bround(F.col("p_size") * 37 * F.lit(0.5), 0).cast("long").alias("target"))
