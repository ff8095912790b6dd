"""Queries over recorded answers of data providers, made up of the supplied tables' rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows
from tarnbeck.sources import payloads as R


def _answers(t: Tables, sql: str) -> DataFrame:
    """Rows of SQL in which braces stand for themselves, but around the name of a table."""
    return rows(t, re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}")))


def _text(path: str) -> str:
    return f"json_extract_string(payload, '{path}')"


def _number(source: str, path: str, kind: str = "DOUBLE") -> str:
    return f"cast(json_extract_string({source}, '{path}') AS {kind})"


_PROFILES = """SELECT c_custkey AS ticker, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '{"longName": null}' WHEN c_custkey % 11 = 0 THEN '{"longName": "", "sector": "x"}'
    ELSE '{"longName": "' || c_name || '", "sector": "' || c_mktsegment || '", "country": null, "fullTimeEmployees": ' || (c_nationkey * 1000) || ', "marketCap": ' || (c_custkey * 1000000) || ', "currency": "USD", "beta": 1.5}' END AS payload FROM {customer}"""


@query("A09_profiles", f"""SELECT * FROM (SELECT ticker, {', '.join(f"cast({_text('$.' + f.split()[0])} AS {f.split()[1].replace('STRING', 'VARCHAR')}) AS {f.split()[0]}" for f in R.PROFILE.split(', '))} FROM ({plain(_PROFILES)})) WHERE coalesce(longName, '') <> ''""")
def profiles(t: Tables):
    return R.profiles(_answers(t, _PROFILES))


_ROW = """{"current": ' || p_size || ', "7daysAgo": ' || (p_size % 5) || ', "30daysAgo": null, "60daysAgo": -' || (p_size + 3) || ', "90daysAgo": ' || (p_partkey % 97) || '}"""
_TRENDS = f"""SELECT p_partkey AS ticker, CASE p_partkey % 6 WHEN 0 THEN '{{"eps_trend": {{}}}}' WHEN 1 THEN '{{"eps_trend": null}}' WHEN 2 THEN '{{"eps_trend": {{"0q": {_ROW}, "2027": {_ROW}}}}}'
    ELSE '{{"eps_trend": {{"0q": {_ROW}, "+1q": {_ROW}, "0y": {{"current": null, "7daysAgo": 2}}, "+1y": {_ROW}}}}}' END AS payload FROM {{part}}"""
_PERIOD = "CASE key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.PERIODS.items()) + " ELSE key END"


@query("A11_estimate_trends", f"""WITH k AS (SELECT ticker, payload, unnest(json_keys(payload, '$.eps_trend')) AS key FROM ({plain(_TRENDS)}) WHERE json_type(payload, '$.eps_trend') = 'OBJECT'),
    r AS (SELECT ticker, {_PERIOD} AS period, json_extract(payload, '$.eps_trend."' || key || '"') AS v FROM k)
    SELECT ticker, period, {_number('v', '$.current')} AS current, {', '.join(f"round(({_number('v', '$.current')} - {_number('v', f'$.{a}')}) / nullif(abs({_number('v', f'$.{a}')}), 0) * 100, 1) AS revision_pct_{n}" for n, a in R.AGO.items())} FROM r""")
def estimate_trends(t: Tables):
    return R.estimate_trends(_answers(t, _TRENDS))


_TARGETS = """SELECT s_suppkey AS ticker, CASE s_suppkey % 5 WHEN 0 THEN '{"price_targets": {}}' WHEN 1 THEN '{"price_targets": {"current": 0, "mean": 12}}'
    ELSE '{"price_targets": {"current": ' || (s_suppkey + 10) || ', "mean": ' || (s_nationkey * 7 + 1) || ', "high": ' || (s_suppkey * 2) || ', "median": null}}' END AS payload FROM {supplier}"""
_KINDS = ["mean", "median", "high", "low"]


@query("A12_price_targets", f"""WITH p AS (SELECT ticker, {', '.join(f"{_number('payload', f'$.price_targets.{k}')} AS {k}" for k in ['current', *_KINDS])} FROM ({plain(_TARGETS)}))
    SELECT *, {', '.join(f'round(({k} - current) / nullif(current, 0) * 100, 1) AS upside_pct_{k}' for k in _KINDS)} FROM p WHERE coalesce(current, {', '.join(_KINDS)}) IS NOT NULL""")
def price_targets(t: Tables):
    return R.price_targets(_answers(t, _TARGETS))


_ACTION = "'{\"date\": \"' || substr(cast(o_orderdate AS {text}), 1, 10) || '\", \"Firm\": \"' || o_orderpriority || '\", \"ToGrade\": \"' || o_orderstatus || '\"}'"


@query("A12_rating_actions", """SELECT * FROM (SELECT o_custkey % 100 AS ticker, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY substr(cast(o_orderdate AS VARCHAR), 1, 10) DESC, o_orderkey) AS n,
    substr(cast(o_orderdate AS VARCHAR), 1, 10) AS date, o_orderpriority AS firm, o_orderstatus AS grade FROM orders WHERE o_custkey % 100 <> 7) WHERE n <= 25""")
def rating_actions(t: Tables):
    one = _ACTION.replace("{text}", "STRING")
    answers = f"""SELECT k AS ticker, CASE WHEN k = 7 THEN '{{"upgrades_downgrades": []}}' ELSE '{{"upgrades_downgrades": [' || array_join(transform(array_sort(collect_list(struct(o_orderkey, a))), x -> x.a), ', ') || ']}}' END AS payload
        FROM (SELECT o_custkey % 100 AS k, o_orderkey, {one} AS a FROM {{orders}}) GROUP BY k"""
    return R.rating_actions(_answers(t, answers))


_DATES = """SELECT o_orderkey AS ticker, CASE o_orderkey % 4 WHEN 0 THEN '{"calendar": {}, "earnings_dates": [1, 2]}' WHEN 1 THEN '{"calendar": null}' WHEN 2 THEN 'no answer'
    ELSE '{"calendar": {"Ex-Dividend Date": "2024-01-01"}, "earnings_dates": {"2024-02-0' || (1 + o_orderkey % 9) || '": {"EPS Estimate": ' || (o_custkey % 50) || '.25, "Reported EPS": null}, "2023-11-01": {"EPS Estimate": null, "Reported EPS": -' || (o_custkey % 7) || '.5}}}' END AS payload FROM {orders}"""


@query("A13_earnings_dates", f"""WITH k AS (SELECT ticker, payload, unnest(json_keys(payload, '$.earnings_dates')) AS date FROM ({plain(_DATES)}) WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END, '$.earnings_dates') = 'OBJECT'),
    r AS (SELECT ticker, date, json_extract(payload, '$.earnings_dates."' || date || '"') AS v FROM k) SELECT ticker, date, {_number('v', '$."EPS Estimate"')} AS estimate, {_number('v', '$."Reported EPS"')} AS reported FROM r""")
def earnings_dates(t: Tables):
    return R.earnings_dates(_answers(t, _DATES))


_SERIES = """SELECT 'S' || n_nationkey AS ticker, CASE n_nationkey % 4 WHEN 0 THEN '{"series": {"title": "' || n_name || '"}, "observations": []}' WHEN 1 THEN '{"observations": [{"date": "2024-01-02", "value": "."}, {"date": "2024-01-03", "value": "4.1"}]}'
    ELSE '{"series": {"title": "' || n_name || '", "units": "Percent"}, "observations": [{"realtime_start": "2024-02-01", "date": "2024-01-' || (10 + n_nationkey % 20) || '", "value": "3.9"}]}' END AS payload FROM {nation}"""


@query("A20_published_series", f"""SELECT ticker, coalesce(nullif({_text('$.series.title')}, ''), 'FRED ' || ticker) AS title, {_text('$.observations[#-1].date')} AS as_of, cast(json_array_length(payload, '$.observations') AS BIGINT) AS n
    FROM ({plain(_SERIES)}) WHERE json_array_length(payload, '$.observations') > 0""")
def published_series(t: Tables):
    return R.published_series(_answers(t, _SERIES))


_NEWS = """SELECT page_id AS ticker, CASE page_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[{"content": {"title": "T' || page_id || '", "canonicalUrl": {"url": "' || url || '"}, "provider": {"displayName": "P"}, "pubDate": "2024-01-01T00:00:00Z"}}, {"content": {"title": "no address"}}]'
    ELSE '[{"title": "F' || page_id || '", "link": "' || url || '", "providerPublishTime": ' || (1700000000 + page_id) || '}, {"title": "", "link": "u"}]' END AS payload FROM {pages}"""


@query("A17_articles", f"""SELECT ticker, CAST(0 AS INTEGER) AS place, coalesce({_text('$[0].content.title')}, {_text('$[0].title')}) AS title, coalesce({_text('$[0].content.canonicalUrl.url')}, {_text('$[0].link')}) AS url,
    coalesce({_text('$[0].content.provider.displayName')}, {_text('$[0].publisher')}, '') AS publisher, coalesce({_text('$[0].content.pubDate')}, strftime(make_timestamp({_number('payload', '$[0].providerPublishTime', 'BIGINT')} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')) AS published
    FROM ({plain(_NEWS)}) WHERE json_array_length(payload) > 0""")
def articles(t: Tables):
    return R.articles(_answers(t, _NEWS))


_STATEMENTS = """SELECT c_custkey AS ticker, CASE c_custkey % 3 WHEN 0 THEN '{"income_stmt": {}}' ELSE '{"income_stmt": {"2023-12-31": {"Total Revenue": ' || c_custkey || ', "Net Income": null}, "2022-12-31": {"Total Revenue": ' || (c_custkey - 1) || '}}, "info": {"x": 1}}' END AS payload FROM {customer}"""


@query("A10_statement_items", f"""WITH k AS (SELECT ticker, payload, unnest(json_keys(payload, '$.income_stmt')) AS period FROM ({plain(_STATEMENTS)})),
    i AS (SELECT ticker, period, json_extract(payload, '$.income_stmt."' || period || '"') AS v FROM k), n AS (SELECT *, unnest(json_keys(v)) AS item FROM i)
    SELECT ticker, period, item, cast(json_extract_string(v, '$."' || item || '"') AS DOUBLE) AS value FROM n""")
def statement_items(t: Tables):
    return R.statement_items(_answers(t, _STATEMENTS), "income_stmt")


_RATIOS = """SELECT p_partkey AS ticker, '{"highlights": {"market_cap": ' || (p_partkey * 10) || ', "total_debt": ' || CASE WHEN p_partkey % 9 = 0 THEN 'null' ELSE '' || p_size END || ', "total_cash": ' || (p_size * 2) || ', "revenue_ttm": ' || (p_partkey % 40) || ', "ebitda": ' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '' || (p_size + 7) END || ', "enterprise_value": ' || (p_partkey * 10 + p_partkey % 50) || '}}' AS payload FROM {part}"""
_HIGH = {f: _number("payload", f"$.highlights.{f}") for f in ("market_cap", "total_debt", "total_cash", "revenue_ttm", "ebitda", "enterprise_value")}


@query("A10_computed_multiples", f"""WITH h AS (SELECT ticker, {', '.join(f'{v} AS {k}' for k, v in _HIGH.items())} FROM ({plain(_RATIOS)})), e AS (SELECT *, market_cap + total_debt - total_cash AS ev FROM h)
    SELECT ticker, ev, round(ev / nullif(revenue_ttm, 0), 3) AS ev_to_revenue, round(ev / nullif(ebitda, 0), 3) AS ev_to_ebitda, coalesce(abs(nullif(enterprise_value, 0) / nullif(ev, 0) - 1) > 0.02, false) AS diverges FROM e WHERE ev IS NOT NULL""")
def computed_multiples(t: Tables):
    return R.computed_multiples(_answers(t, _RATIOS))


@query("A19_newest_rows", """WITH r AS (SELECT o_custkey % 50 AS ticker, CASE WHEN o_custkey % 2 = 0 THEN 'short_interest' ELSE 'insider_trading' END AS dataset, CASE WHEN o_orderkey % 10 <> 3 THEN substr(cast(o_orderdate AS VARCHAR), 1, 10) END AS date, o_orderkey FROM orders)
    SELECT * FROM (SELECT ticker, dataset, row_number() OVER (PARTITION BY ticker, dataset ORDER BY date DESC NULLS LAST, o_orderkey) AS n, date FROM r) WHERE n <= CASE dataset WHEN 'short_interest' THEN 26 ELSE 60 END""")
def newest_rows(t: Tables):
    answers = """SELECT k AS ticker, '{"data": {"' || s || '": [' || array_join(transform(array_sort(collect_list(struct(o_orderkey, a))), x -> x.a), ', ') || '], "other": [{"date": "2024-01-01"}]}}' AS payload
        FROM (SELECT o_custkey % 50 AS k, CASE WHEN o_custkey % 2 = 0 THEN 'short_interest' ELSE 'insider_trading' END AS s, o_orderkey,
            '{"shares": 5, "filing_date": ' || CASE WHEN o_orderkey % 10 <> 3 THEN '"' || substr(cast(o_orderdate AS STRING), 1, 10) || '"' ELSE 'null' END || '}' AS a FROM {orders}) GROUP BY k, s"""
    return R.newest_rows(_answers(t, answers))


_PEERS = """SELECT s_suppkey AS ticker, CASE s_suppkey % 4 WHEN 0 THEN '{"Error Message": "limit"}' WHEN 1 THEN '[]' ELSE '[{"symbol": "P' || s_nationkey || '", "price": 1.5}, {"companyName": "none"}, {"symbol": ""}]' END AS payload FROM {supplier}"""


@query("A22_peer_symbols", f"SELECT ticker, cast(0 AS INTEGER) AS place, {_text('$[0].symbol')} AS symbol FROM ({plain(_PEERS)}) WHERE json_type(payload) = 'ARRAY' AND json_array_length(payload) > 0")
def peer_symbols(t: Tables):
    return R.peer_symbols(_answers(t, _PEERS))


_FUNDS = """SELECT s_suppkey AS ticker, '[{"symbol": "F' || s_nationkey || '", "asset": "X", "weightPercentage": ' || CASE WHEN s_suppkey % 5 = 0 THEN 'null' ELSE s_suppkey || '.25' END || ', "marketValue": ' || (s_suppkey * 1000) || '}]' AS payload FROM {supplier}"""


@query("A22_exposures", f"SELECT ticker, {_text('$[0].symbol')} AS fund, {_number('payload', '$[0].weightPercentage')} / 100 AS weight, {_number('payload', '$[0].marketValue')} AS market_value FROM ({plain(_FUNDS)})")
def exposures(t: Tables):
    return R.exposures(_answers(t, _FUNDS))


_ERRORS = "SELECT event_id AS id, 'GET https://x.org/v?symbol=' || event_type || CASE event_id % 3 WHEN 0 THEN '&apikey=k' WHEN 1 THEN '&Token=\"t' ELSE '&monkey=b' END || event_id || '&page=2 failed' AS message FROM {events}"


@query("A23_without_secrets", f"""SELECT id, regexp_replace(message, '{R.SECRETS.replace("'", "''")}', '\\1={R.REDACTED}', 'g') AS message FROM ({plain(_ERRORS)})""")
def without_secrets(t: Tables):
    return rows(t, _ERRORS).select("id", R.without_secrets(F.col("message")).alias("message"))
