"""Queries over filings, calls, logs and verdicts, over what sinks write, rules as strings, and exhibits' frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import artifacts as A
from tarnbeck.operators import findings as N
from tarnbeck.operators import market as M
from tarnbeck.operators import peers as P
from tarnbeck.operators import provenance as V
from tarnbeck.operators.gates import MODEL_KINDS, SOURCE_KINDS
from tarnbeck.plans.base import CORPUS, Tables, query
from tarnbeck.plans.company import _WEEKS
from tarnbeck.plans.corpus import _quoted
from tarnbeck.plans.payloads import _answers, _text
from tarnbeck.plans.reports import plain, rows
from tarnbeck.sources import filings as R

_DAY = "substr(cast(o_orderdate AS VARCHAR(40)), 1, 10)"

_FILINGS = """SELECT c_custkey AS ticker, CASE c_custkey % 5 WHEN 0 THEN '{"tenk": null}' WHEN 1 THEN 'no answer' WHEN 2 THEN '{"tenk": {"filing_date": "2023-0' || (1 + c_nationkey % 9) || '-15", "period_end": "2022-12-31"}, "tenq": {"filing_date": ""}}'
    ELSE '{"tenk": {"filing_date": "2023-02-1' || (c_nationkey % 10) || '", "items": {"1": "x"}}, "tenq": {"filing_date": "2023-11-0' || (1 + c_nationkey % 9) || '", "period_end": "2023-09-30"}}' END AS payload FROM {customer}"""
_VALID = f"SELECT ticker, payload FROM ({plain(_FILINGS)}) WHERE json_valid(payload)"


@query("A14_filings", " UNION ALL ".join(f"SELECT ticker, '{slug}' AS form, {_text(f'$.{key}.filing_date')} || '_{slug}' AS id, {_text(f'$.{key}.period_end')} AS period_end FROM ({_VALID}) WHERE coalesce({_text(f'$.{key}.filing_date')}, '') <> ''" for key, slug in R.FORMS.items()))
def filings(t: Tables):
    return R.filed(_answers(t, _FILINGS))


@query("A14_current_reports", f"""SELECT o_custkey AS ticker, row_number() OVER (PARTITION BY o_custkey ORDER BY {_DAY} DESC, o_orderkey) AS n, {_DAY} AS filing_date, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'A' || o_orderkey END AS accession
    FROM orders WHERE {_DAY} >= cast(date '1998-08-02' - 365 AS VARCHAR)""")
def current_reports(t: Tables):
    one = f"""'{{"filing_date": "' || {_DAY} || '", "accession": ' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"A' || o_orderkey || '"' END || '}}'"""
    answers = f"""SELECT k AS ticker, '{{"eightks": [' || array_join(transform(array_sort(collect_list(struct(o_orderkey, a))), x -> x.a), ', ') || ']}}' AS payload FROM (SELECT o_custkey AS k, o_orderkey, {one} AS a FROM {{orders}}) GROUP BY k"""
    return R.current_reports(_answers(t, answers), "1998-08-02")


_CALLS = """SELECT p_partkey AS ticker, CASE p_partkey % 6 WHEN 0 THEN '[]' WHEN 1 THEN '[{"date": "2024-05-01", "fiscalYear": "soon", "quarter": 1}, {"date": "2024-02-01", "fiscalYear": 2023, "quarter": 4}]' WHEN 2 THEN '{"Error": "x"}'
    ELSE '[{"date": "2023-0' || (1 + p_size % 9) || '-20", "fiscalYear": 2023, "quarter": ' || (1 + p_size % 4) || '}, {"date": "2023-05-20", "fiscalYear": ' || (2000 + p_partkey % 24) || ', "quarter": 2}, {"date": null, "fiscalYear": 2030, "quarter": 1}]' END AS payload FROM {part}"""


@query("A15_latest_call", f"""WITH d AS (SELECT ticker, payload, unnest(range(cast(json_array_length(payload) AS BIGINT))) AS i FROM ({plain(_CALLS)}) WHERE json_type(payload) = 'ARRAY'),
    c AS (SELECT ticker, i, json_extract(payload, '$[' || i || ']') AS c FROM d), k AS (SELECT ticker, i, json_extract_string(c, '$.date') AS date, json_extract_string(c, '$.fiscalYear') AS y, json_extract_string(c, '$.quarter') AS q FROM c),
    n AS (SELECT * FROM k WHERE date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, i) = 1)
    SELECT ticker, date, try_cast(y AS INTEGER) AS year, try_cast(q AS INTEGER) AS quarter FROM n WHERE try_cast(y AS INTEGER) IS NOT NULL AND try_cast(q AS INTEGER) IS NOT NULL""")
def latest_call(t: Tables):
    return R.latest_call(_answers(t, _CALLS))


_PRIOR = "SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 3 = 0 THEN '2024-02-20T21:00:00Z' ELSE '2023-11-20' END AS prior_date, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'untitled' ELSE 'XQ4 2023 Q' || (1 + p_size % 4) || ' ' || (2022 + p_size % 2) || ' Call' END AS prior_title, '2024-02-20' AS date, cast(4 AS INT) AS quarter, cast(2023 AS INT) AS year FROM {part}"


@query("A15_call_action", f"""SELECT id, CASE WHEN substr(prior_date, 1, 10) = date THEN 'unchanged' WHEN regexp_extract(prior_title, '\\bQ(\\d)\\s+(\\d{{4}})\\b', 1) = cast(quarter AS VARCHAR) AND regexp_extract(prior_title, '\\bQ(\\d)\\s+(\\d{{4}})\\b', 2) = cast(year AS VARCHAR) THEN 'supersedes' ELSE 'new' END AS action FROM ({plain(_PRIOR)})""")
def call_action(t: Tables):
    c = F.col
    return rows(t, _PRIOR).select("id", R.call_action(c("prior_date"), c("prior_title"), c("date"), c("quarter"), c("year")).alias("action"))


_WORDS = "repeat(c_name || ' makes things. ', c_nationkey % 6)"
_ENCYCLOPEDIA = f"""SELECT c_custkey AS ticker, CASE c_custkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{{"title": "Short", "url": "s", "summary": "short", "content": "c"}}, {{"title": "' || c_name || '", "url": "u' || c_custkey || '", "summary": "' || {_WORDS} || '", "content": "all"}}]'
    ELSE '[{{"title": "' || c_name || '", "url": "v", "summary": "' || {_WORDS} || '", "content": null}}]' END AS payload FROM {{customer}}"""


@query("A16_encyclopedia", f"""WITH d AS (SELECT ticker, payload, unnest(range(cast(json_array_length(payload) AS BIGINT))) AS i FROM ({plain(_ENCYCLOPEDIA)})), p AS (SELECT ticker, i, json_extract(payload, '$[' || i || ']') AS payload FROM d)
    SELECT ticker, {_text('$.title')} AS title, {_text('$.url')} AS url, '## Summary' || chr(10) || chr(10) || {_text('$.summary')} || chr(10) || chr(10) || '## Full article' || chr(10) || chr(10) || coalesce({_text('$.content')}, '') AS body
    FROM p WHERE length({_text('$.summary')}) >= 100 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY i) = 1""")
def encyclopedia(t: Tables):
    return R.encyclopedia(_answers(t, _ENCYCLOPEDIA))


_TOPICS = "SELECT o_custkey AS ticker, o_orderpriority AS topic, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'answer ' || o_orderkey END AS content FROM {orders}"


@query("A18_topic_outcome", f"SELECT ticker, count(*) FILTER (trim(coalesce(content, '')) <> '') AS written, count(*) FILTER (trim(coalesce(content, '')) = '') AS failed, count(*) FILTER (trim(coalesce(content, '')) <> '') > 0 AS ok FROM ({plain(_TOPICS)}) GROUP BY ticker")
def topic_outcome(t: Tables):
    return R.topic_outcome(rows(t, _TOPICS))


_CONFIG = "SELECT cast(n_nationkey AS INT) AS place, CASE n_nationkey WHEN 0 THEN 'profile' WHEN 1 THEN 'business_model' WHEN 2 THEN 'supply_chain' WHEN 3 THEN NULL WHEN 4 THEN 'financial' WHEN 5 THEN 'valuation' ELSE 'risk_news' END AS section, CASE WHEN n_nationkey <> 5 THEN n_regionkey + 2 END AS seeds FROM {nation} WHERE n_nationkey < 9"
_EXPECTED = "[" + ", ".join(f"'{s}'" for s in R.SECTIONS) + "]"


@query("A27_section_problems", f"SELECT place, 'order' AS problem FROM ({plain(_CONFIG)}) WHERE section IS DISTINCT FROM {_EXPECTED}[place + 1] UNION ALL SELECT place, 'seeds' FROM ({plain(_CONFIG)}) WHERE NOT (coalesce(seeds, 0) BETWEEN 4 AND 6)")
def section_problems(t: Tables):
    return R.section_problems(rows(t, _CONFIG))


_LEDGERS = """SELECT c_custkey AS ticker, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE '[{"hash": "h' || c_custkey || '", "section": "' || c_mktsegment || '", "status": "open", "attempts": ' || (c_nationkey % 4) || '}, {"hash": "k' || c_custkey || '", "status": "answered"}]' END AS payload FROM {customer}"""


@query("A28_ledgers", f"""WITH d AS (SELECT ticker, payload AS p, unnest(range(cast(json_array_length(payload) AS BIGINT))) AS i FROM ({plain(_LEDGERS)})), q AS (SELECT ticker, json_extract(p, '$[' || i || ']') AS payload FROM d)
    SELECT ticker, {_text('$.hash')} AS hash, {_text('$.section')} AS section, {_text('$.status')} AS status, cast({_text('$.attempts')} AS INTEGER) AS attempts FROM q""")
def ledgers(t: Tables):
    return R.ledger(_answers(t, _LEDGERS))


_LOGS = f"""SELECT o_custkey AS run, lpad(cast(o_orderkey AS VARCHAR(20)), 8, '0') AS name, CASE o_orderkey % 5 WHEN 0 THEN 'written badly' ELSE '---' || chr(10) || 'purpose: ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '"' || o_orderpriority || '"' END || chr(10)
    || 'round: ' || CASE WHEN o_orderkey % 7 = 0 THEN 'two' ELSE cast(o_orderkey % 4 AS VARCHAR(20)) END || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'section: ' || o_orderstatus || chr(10) ELSE '' END || CASE WHEN o_orderkey % 11 <> 1 THEN 'started_at: ' || {_DAY} || chr(10) ELSE '' END || '---' || chr(10) || 'label: not mine' END AS text FROM {{orders}}"""
_MATTER = "regexp_extract(text, '(?s)^---\\n(.*?)\\n---', 1)"


def _field(name: str) -> str:
    return f"nullif(trim(regexp_extract({_MATTER}, '(?m)^{name}:[ \\t]*(.*)$', 1), ' ''\"'), '')"


@query("A29_task_logs", f"""WITH f AS (SELECT run, name, coalesce({_field('purpose')}, 'unknown') AS purpose, {_field('section')} AS section, coalesce({_field('label')}, name) AS label, try_cast({_field('round')} AS INTEGER) AS round, coalesce({_field('started_at')}, '') AS started_at, coalesce({_field('status')}, 'ok') AS status FROM ({plain(_LOGS)}))
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY started_at = '', started_at, name) AS place FROM f""")
def task_logs(t: Tables):
    return R.task_logs(rows(t, _LOGS))


_VERDICTS = """SELECT o_custkey AS ticker, substr(cast(o_orderdate AS VARCHAR(40)), 1, 10) || '_' || o_orderkey AS run, o_orderkey % 101 = 0 AS latest, CASE o_orderkey % 4 WHEN 0 THEN 'broken {' WHEN 1 THEN '[1]' ELSE '{"rating": "Buy", "n": ' || o_orderkey || '}' END AS payload FROM {orders}"""


@query("A30_latest_verdict", f"SELECT ticker, run, payload FROM ({plain(_VERDICTS)}) WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY latest DESC, run DESC) = 1")
def latest_verdict(t: Tables):
    return R.latest_verdict(_answers(t, _VERDICTS))


_HELD = "SELECT 's' || p_partkey AS id, CASE WHEN p_size < 25 THEN 'news' ELSE 'transcript' END AS kind, CASE WHEN p_size > 45 THEN date '2023-06-01' END AS archived_on FROM {part}"
_NEW = "SELECT CASE WHEN o_orderkey % 13 = 0 THEN '../s' || o_orderkey ELSE 's' || (o_orderkey % 5000) END AS id, CASE o_orderkey % 6 WHEN 0 THEN 'research_answer' WHEN 1 THEN 'news' WHEN 2 THEN 'web_page' ELSE 'transcript' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 's' || o_custkey END AS supersedes, o_orderkey AS ord FROM {orders}"
_KINDS = ", ".join(f"'{k}'" for k in SOURCE_KINDS)


@query("B01_sources_after_append", f"""WITH h AS ({plain(_HELD)}), n AS (SELECT * FROM ({plain(_NEW)}) WHERE kind IN ({_KINDS}) AND NOT contains(id, '/') QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1), a AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM h))
    SELECT id, kind, coalesce(archived_on, CASE WHEN id IN (SELECT supersedes FROM a WHERE supersedes IS NOT NULL) THEN date '2024-02-01' END) AS archived_on FROM h UNION ALL SELECT id, kind, NULL FROM a""")
def sources_after_append(t: Tables):
    return A.append_sources(rows(t, _HELD), rows(t, _NEW), "2024-02-01")


_ANSWERS = "SELECT 's' || p_partkey AS id FROM {part}"


@query("B02_answers_after_append", f"SELECT id FROM ({plain(_ANSWERS)}) UNION SELECT id FROM ({plain(_NEW)}) WHERE kind IN ({', '.join(repr(k) for k in MODEL_KINDS)}) AND NOT contains(id, '/')")
def answers_after_append(t: Tables):
    return A.append_answers(rows(t, _ANSWERS), rows(t, _NEW))


_OLD = """SELECT 'a' || p_partkey AS id, timestamp '2023-05-01 00:00:00' AS stamp, '{{"old": ' || p_size || '}}' AS request FROM {part}"""
_FRESH = """SELECT 'a' || max(o_custkey) AS id, max(o_orderdate) AS stamp, CASE WHEN o_custkey % 9 = 0 THEN '{{"q": [{{"Token": "x"}}]}}' ELSE '{{"n": ' || o_custkey || '}}' END AS request, CASE o_custkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'compute' ELSE 'fetch' END AS producer FROM {orders} GROUP BY o_custkey"""


@query("B03_artifacts_after_upsert", f"""WITH b AS (SELECT id, stamp, request, 0 AS fresh FROM ({plain(_OLD).replace('{{', '{').replace('}}', '}')}) UNION ALL SELECT id, stamp, request, 1 FROM ({plain(_FRESH).replace('{{', '{').replace('}}', '}')}) WHERE producer <> 'model' AND NOT contains(request, 'Token'))
    SELECT id, stamp, request FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY stamp DESC, fresh DESC) = 1""")
def artifacts_after_upsert(t: Tables):
    return A.upsert(rows(t, _OLD), rows(t, _FRESH))


_MANIFEST = "SELECT source AS ticker, 'd' || doc_id AS id, lang AS kind, CASE WHEN doc_id % 9 = 0 THEN '' ELSE '2024-01-' || lpad(cast(1 + doc_id % 28 AS VARCHAR(9)), 2, '0') END AS as_of, octet_length(cast(text AS {b})) AS bytes, substr(text, 1, 0) || 'a | b ' || n_chars AS summary FROM {{documents}}"


@query("B06_manifest_lines", f"""SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC, id) AS place, '| ' || id || ' | ' || kind || ' | ' || as_of || ' | ' || bytes || ' | ' || replace(summary, '|', '\\|') || ' |' AS line
    FROM (SELECT * FROM ({plain(_MANIFEST.format(b='VARCHAR')).replace('octet_length', 'strlen')}))""")
def manifest_lines(t: Tables):
    return A.manifest_lines(rows(t, _MANIFEST.format(b="STRING")))


_CITED = "SELECT l_orderkey AS answer, 'u' || l_partkey AS url FROM {lineitem}"
_PAGES = "SELECT 'u' || p.p_partkey AS url, o.o_orderkey AS id, o.o_orderdate AS stamp FROM {part} p JOIN {orders} o ON o.o_custkey = p.p_partkey WHERE p.p_size < 30"


@query("B08_url_map", f"SELECT DISTINCT c.answer, c.url, m.source FROM ({plain(_CITED)}) c LEFT JOIN (SELECT url, arg_max(id, (stamp, id)) AS source FROM ({plain(_PAGES)}) GROUP BY url) m ON m.url = c.url")
def url_map(t: Tables):
    return A.url_map(rows(t, _CITED), rows(t, _PAGES))


_REFS = "SELECT l_orderkey AS doc, l_linenumber AS number, 'p' || l_partkey AS id FROM {lineitem}"
_SOURCES = "SELECT 'p' || p_partkey AS id, p_name AS title, p_brand AS source, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://x.org/' || p_partkey END AS url, CASE WHEN p_size % 2 = 0 THEN '2024-01-05T10:00:00Z' ELSE '2024-01-06' END AS fetched FROM {part} WHERE p_size > 3"


@query("B09_references", f"""SELECT doc, number, r.id, '[' || number || '] ' || title || ' — ' || source || CASE WHEN coalesce(url, '') <> '' THEN ', ' || url ELSE '' END || ' — fetched ' || substr(fetched, 1, 10) AS line FROM ({plain(_REFS)}) r LEFT JOIN ({plain(_SOURCES)}) s ON s.id = r.id""")
def references(t: Tables):
    return A.references(rows(t, _REFS), rows(t, _SOURCES))


_CHARTS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Bad Name' WHEN 1 THEN NULL WHEN 2 THEN '../x' ELSE 'price_' || o_orderkey || '-a' END AS name, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderpriority END AS source FROM {orders}"


@query("B10_exhibit_problems", f"SELECT id, 'name' AS problem FROM ({plain(_CHARTS)}) WHERE NOT coalesce(regexp_matches(name, '{A.EXHIBIT}'), false) UNION ALL SELECT id, 'no sources' FROM ({plain(_CHARTS)}) WHERE source IS NULL")
def exhibit_problems(t: Tables):
    made = rows(t, _CHARTS).withColumn("data_sources", F.array_compact(F.array("source")))
    return N.findings(made, ["id"], A.exhibit_problems())


_WIKI = "SELECT c_nationkey AS ticker, CASE c_custkey % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'financial' ELSE 'entities/x' END AS name, max(c_name) || ' | x' AS summary, '2024-01-05T00:00:00Z' AS updated, count(*) AS sources, count(DISTINCT c_mktsegment) AS questions, max(c_acctbal) > 9500 AS dirty FROM {customer} GROUP BY c_nationkey, c_custkey % 3"
_ENTRY = "'| ' || s.place || ' | [' || s.name || '](' || s.name || '.md) | ' || replace(summary, '|', '\\|') || ' | ' || substr(updated, 1, 10) || ' | ' || sources || ' | ' || questions || ' | ' || CASE WHEN dirty THEN 'dirty' ELSE '' END || ' |'"


@query("B11_index_lines", f"""WITH w AS ({plain(_WIKI)}), s AS (SELECT unnest({_EXPECTED}) AS name, unnest(range(1, {len(R.SECTIONS) + 1})) AS place), t AS (SELECT DISTINCT ticker FROM w)
    SELECT t.ticker, s.place, CASE WHEN w.ticker IS NULL THEN '| ' || s.place || ' | ' || s.name || ' | — | — | — | — | not written |' ELSE {_ENTRY} END AS line FROM t CROSS JOIN s LEFT JOIN w ON w.ticker = t.ticker AND w.name = s.name""")
def index_lines(t: Tables):
    return A.index_lines(rows(t, _WIKI), R.SECTIONS)


_COSTS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS agents, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey * (o_orderkey % 9) END AS tokens, CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_custkey % 90 AS DOUBLE) + 0.5 END AS minutes, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS run FROM {orders}"
_NOTE = "concat_ws(' · ', CASE WHEN agents = 1 THEN '1 agent' ELSE agents || ' agents' END, CASE WHEN tokens >= 1000 THEN format('{:,}', cast(round_even(tokens / 1000, 0) AS BIGINT)) || 'k tok' ELSE tokens || ' tok' END, CASE WHEN minutes IS NOT NULL THEN printf('%.1f', minutes) || ' min' END)"


@query("B11_cost_notes", f"SELECT id, CASE WHEN note <> '' AND run IS NOT NULL THEN '[' || note || '](../reports/' || run || '/run_log.md)' ELSE note END AS note FROM (SELECT id, run, {_NOTE} AS note FROM ({plain(_COSTS)}))")
def cost_notes(t: Tables):
    c = F.col
    return rows(t, _COSTS).select("id", A.cost_note(c("agents"), c("tokens"), c("minutes"), c("run")).alias("note"))


_BENCH = "view"


@query("D23_benchmark_weeks", f"{_WEEKS} SELECT w.symbol, w.week, w.close, b.close AS other FROM weeks w JOIN weeks b ON b.week = w.week AND b.symbol = '{_BENCH}' WHERE w.symbol <> '{_BENCH}' QUALIFY count(*) OVER (PARTITION BY w.symbol) > 1")
def benchmark_weeks(t: Tables):
    return A.benchmark_weeks(M.weekly(M.daily_bars(t.ticks())), _BENCH)


_RULES = ["contains: the", "regex: ^[A-Z]{3,}", "not_regex: !!", "min_length: 400", "max_length: 5000", "max_length: long", "wishful: x", "contains:the", "no_internal_filenames", "startswith: The", "max_sentence_words: 40", "max_length_prose: 3000"]
_PROSE = f"array_to_string(list_filter(string_split(regexp_replace(body, '{T.CITATION}', '', 'g'), chr(10)), lambda x: NOT regexp_matches(ltrim(x), '^[|#>]')), ' ')"
_LONGEST = f"list_max(list_transform(string_split(regexp_replace({_PROSE}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))))"
_INTERNAL = " OR ".join(f"regexp_matches(regexp_replace(body, '{T.CITATION}', '', 'g'), '{_quoted(p)}')" for p in N.INTERNAL)
_FIRST = "coalesce(list_filter(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')[1], '')"
_FAILS = {0: "NOT contains(body, 'the')", 1: "NOT regexp_matches(body, '(?m)^[A-Z]{3,}')", 2: "regexp_matches(body, '!!')", 3: "length(body) < 400", 4: "length(body) > 5000", 8: _INTERNAL, 9: f"NOT starts_with({_FIRST}, 'The')", 10: f"{_LONGEST} > 40", 11: f"length(regexp_replace(body, '{T.CITATION}', '', 'g')) > 3000"}
_ALWAYS = {5: "not a number", 6: "unknown rule", 7: "malformed"}
_DRAFTS = "d AS (SELECT doc_id AS id, coalesce(text, '') AS body FROM documents)"


@query("K04_rule_strings", f"WITH {_DRAFTS} " + " UNION ALL ".join([f"SELECT id, {i} AS place, 'failed' AS problem FROM d WHERE {sql}" for i, sql in _FAILS.items()] + [f"SELECT id, {i}, '{what}' FROM d" for i, what in _ALWAYS.items()]))
def rule_strings(t: Tables):
    return A.rule_strings(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), _RULES)


_TARGETS = "SELECT s_suppkey AS id, s_acctbal AS current, s_acctbal + 10 AS mean, s_acctbal + 20.5 AS high, CASE WHEN s_nationkey > 3 THEN s_acctbal - 5 END AS low, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN -1.5 ELSE 2.5 END AS upside_pct_mean FROM {supplier}"


@query("I34_targets", f"""SELECT id, {', '.join(f"CASE WHEN {k} IS NOT NULL THEN printf('%.2f', {k}) END AS {k}" for k in ('mean', 'high', 'low', 'current'))}, CASE WHEN upside_pct_mean > 0 THEN 'pos' WHEN upside_pct_mean < 0 THEN 'neg' ELSE 'flat' END AS upside_direction,
    CASE WHEN upside_pct_mean > 0 THEN '▲' WHEN upside_pct_mean < 0 THEN '▼' WHEN upside_pct_mean = 0 THEN '→' ELSE '' END AS upside_arrow FROM ({plain(_TARGETS)})""")
def targets(t: Tables):
    made = rows(t, _TARGETS).select("id", "upside_pct_mean", *[F.col(k).cast("double").alias(k) for k in ("mean", "high", "low", "current")])
    shown = [F.when(F.col(k).isNotNull(), c).alias(k) for k, c in zip(("mean", "high", "low", "current"), A.targets())]
    return made.select("id", *shown, *A.targets()[4:])


_EARNINGS = f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN 'next week' WHEN o_orderkey % 8 > 1 THEN {_DAY} END AS day FROM {{orders}}"


@query("I34_earnings_label", f"SELECT id, coalesce(strftime(try_cast(day AS DATE), '%d %b'), day) AS label FROM ({plain(_EARNINGS)})")
def earnings_label(t: Tables):
    return rows(t, _EARNINGS).select("id", A.earnings_label(F.col("day")).alias("label"))


_OPEN = "SELECT o_custkey AS qid, o_orderkey AS ord, o_orderkey % 500 AS id, o_orderdate AS stamp FROM {orders}"
_STAMPS = "SELECT o_orderkey % 500 AS id, max(o_orderdate) AS stamp FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_orderkey % 500"


@query("L05_reopened", f"WITH b AS (SELECT qid, arg_min(a.id, ord) AS evidence FROM ({plain(_OPEN)}) a LEFT JOIN ({plain(_STAMPS)}) s ON s.id = a.id WHERE s.stamp > a.stamp OR a.id % 97 = 0 GROUP BY qid) SELECT c_custkey AS qid, CASE WHEN b.qid IS NULL THEN 'answered' ELSE 'reopened' END AS status, evidence FROM customer LEFT JOIN b ON b.qid = c_custkey")
def reopened(t: Tables):
    """Answered questions after an invalidation is applied, with the evidence that reopens them."""
    old = rows(t, "SELECT DISTINCT o_orderkey % 500 AS id FROM {orders} WHERE o_orderkey % 500 % 97 = 0")
    bad = V.invalidated(rows(t, _OPEN), rows(t, _STAMPS), old)
    asked = t("customer").select(F.col("c_custkey").alias("qid"))
    return asked.join(bad, "qid", "left").select("qid", F.when(F.col("evidence").isNull(), "answered").otherwise("reopened").alias("status"), "evidence")


_HOLDINGS = "SELECT l_suppkey AS fund, 'P' || l_partkey AS symbol, sum(cast(l_quantity AS DECIMAL(18,2))) AS weight FROM {lineitem} GROUP BY l_suppkey, l_partkey"
_FACTS = "SELECT p_brand AS grp, 'P' || p_partkey AS symbol, p_size = 7 AS etf, p_size = 8 AS fund, CASE WHEN p_size > 3 THEN p_size <> 9 END AS active FROM {part}"


@query("L06_peer_selection", f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, symbol) AS r FROM ({plain(_HOLDINGS)})), c AS (SELECT symbol, count(*) AS n FROM h WHERE r <= 50 GROUP BY symbol),
    k AS (SELECT grp, c.symbol, n FROM c LEFT JOIN ({plain(_FACTS)}) f ON f.symbol = c.symbol WHERE NOT coalesce(etf, false) AND NOT coalesce(fund, false) AND coalesce(active, true)),
    p AS (SELECT grp, symbol, row_number() OVER (PARTITION BY grp ORDER BY n DESC, symbol) AS place FROM k) SELECT grp, symbol, place, CASE WHEN place <= 5 THEN 'selected' ELSE 'runner_up' END AS tier FROM p""")
def peer_selection(t: Tables):
    """Of each group, candidates by the funds that hold them, without funds and inactive ones; the first five are selected."""
    counts = P.overlap(rows(t, _HOLDINGS))
    plain_ones = counts.join(rows(t, _FACTS), "symbol", "left").where(P.hygienic(F.col("etf"), F.col("fund"), F.col("active")))
    ranked = plain_ones.select("grp", "symbol", F.lit(None).cast("long").alias("pin"), (-F.col("fund_count")).alias("rank"))
    return P.pin_and_fill(ranked)


@query("L10_price_weekly", f"""{_WEEKS} SELECT symbol, week, close, round(CASE WHEN count(*) OVER s = 13 THEN avg(close) OVER s END, 4) AS ma13, round(CASE WHEN count(*) OVER l = 52 THEN avg(close) OVER l END, 4) AS ma52 FROM weeks
    WINDOW s AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), l AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY week DESC) <= 209""")
def price_weekly(t: Tables):
    return A.price_frame(M.weekly(M.daily_bars(t.ticks())))


_CARDS = "SELECT c_custkey AS symbol, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS fair, CASE WHEN c_custkey % 3 <> 0 THEN 1000.0 END AS target_low, cast(4000 AS DOUBLE) AS target_high, c_acctbal * 2 AS year_low, cast(9000 AS DOUBLE) AS year_high, cast(c_nationkey - 4 AS DOUBLE) AS eps, cast(100 AS DOUBLE) AS peer_low, cast(500 AS DOUBLE) AS peer_high FROM {customer}"
_BANDS = {"Analyst targets": ("target_low", "target_high"), "52-week range": ("year_low", "year_high"), "Peer multiple": ("CASE WHEN eps > 0 THEN peer_low * eps END", "CASE WHEN eps > 0 THEN peer_high * eps END")}


@query("L14_football_field", f"WITH c AS ({plain(_CARDS)}), b AS (" + " UNION ALL ".join(f"SELECT symbol, fair, '{n}' AS band, cast({lo} AS DOUBLE) AS low, cast({hi} AS DOUBLE) AS high FROM c" for n, (lo, hi) in _BANDS.items()) + ") SELECT symbol, band, low, high, fair BETWEEN low AND high AS inside FROM b WHERE coalesce(fair, 0) <> 0 AND high > low")
def football_field(t: Tables):
    cards = rows(t, _CARDS)
    return A.bands(cards.select("symbol", *[F.col(c).cast("double").alias(c) for c in cards.columns[1:]]))


_POINTS = f"SELECT o_orderpriority AS series, CASE WHEN o_orderkey % 17 = 0 THEN '1997' ELSE {_DAY} || CASE WHEN o_orderkey % 2 = 0 THEN 'T00:00:00' ELSE '' END END AS date, CASE WHEN o_orderkey % 3 = 0 THEN '.' WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_custkey % 100 AS VARCHAR(9)) || '.25' END AS value FROM {{orders}}"


@query("L14_macro_latest", f"WITH p AS (SELECT series, substr(date, 1, 10) AS date, try_cast(value AS DOUBLE) AS value FROM ({plain(_POINTS)}) WHERE length(date) >= 10) SELECT series, arg_max(date, (date, value)) AS date, arg_max(value, (date, value)) AS value, count(*) AS n FROM p WHERE value IS NOT NULL AND date >= '1993-06-15' GROUP BY series")
def macro_latest(t: Tables):
    return A.newest_points(rows(t, _POINTS), "1998-06-15", 5)
