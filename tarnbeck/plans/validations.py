"""Validation of a corpus made of the tables: documents are sources, parts artifacts and wiki pages, suppliers reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.functions.text import CITATION
from tarnbeck.operators.findings import SECRETS
from tarnbeck.operators.gates import ANCHOR, MODEL_KINDS, SOURCE_KINDS
from tarnbeck.operators.validation import NEEDS, validate
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows

_OPEN, _SHUT, _LINE = "chr(123)", "chr(125)", "chr(10)"
_text = lambda v: f"cast({v} AS varchar(40))"


def _member(name: str, value: str) -> str:
    """A text member of a JSON object, left out where the value is null."""
    return f"coalesce(concat('\"{name}\": \"' || {value} || '\", '), '')"


_TICKER = "CASE WHEN p_size = 1 THEN '_MACRO' WHEN p_size = 2 THEN p_type ELSE concat('SRC', cast(p_size AS varchar(4))) END"
_META = [
    ("id", f"concat('p', {_text('p_partkey')})"), ("ticker", "p_brand"), ("title", "nullif(p_name, 'red widget')"), ("source", "p_type"), ("as_of", "'2024-01-05'"),
    ("provider_tool", "CASE WHEN p_size <> 7 THEN 'tool' END"), ("url", "CASE WHEN p_size > 25 THEN 'https://x' END"), ("fetched_at", "CASE WHEN p_size <> 30 THEN '2024-01-05' END"),
    ("computed_at", "CASE WHEN p_size <> 12 THEN '2024' END"), ("generated_at", "CASE WHEN p_size <> 40 THEN '2024' END"), ("fetch_cmd", "CASE WHEN p_size > 10 THEN 'get' END"),
    ("producer", "CASE p_type WHEN 'STANDARD' THEN 'fetch' WHEN 'MEDIUM' THEN 'compute' WHEN 'PROMO' THEN 'model' WHEN 'LARGE' THEN 'model' WHEN 'SMALL' THEN 'scrape' ELSE 'fetch' END"),
]
_REQUEST = "CASE WHEN p_size < 15 THEN '[[\"token\", \"' || p_name || '\"], [\"page\", 2]]' WHEN p_size < 20 THEN '[\"apikey\", [1, 2], \"' || p_name || '\"]' ELSE '[1]' END"
_ARTIFACT = f"concat({_OPEN}, '\"_meta\": ', {_OPEN}, {', '.join(_member(n, v) for n, v in _META)}, '\"request\": ', {_OPEN}, '\"params\": ', {_REQUEST}, {_SHUT}, ', \"derived_from\": [', CASE WHEN p_size <> 33 THEN '\"p' || {_text('p_partkey')} || '\", \"p' || {_text('p_partkey + 1')} || '\"' ELSE '' END, ']', {_SHUT}, CASE WHEN p_type <> 'ECONOMY' THEN ', \"data\": 1' ELSE '' END, CASE WHEN p_size <> 50 THEN {_SHUT} ELSE '' END)"
_WIKI = f"concat('---', {_LINE}, 'built_from:', {_LINE}, '- id: p', {_text('p_partkey')}, {_LINE}, '  fetched_at: x', {_LINE}, '- d', {_text('p_partkey')}, {_LINE}, '---', {_LINE}, 'See [^p', {_text('p_partkey')}, '], [^d', {_text('p_partkey')}, '] and [^p', {_text('p_partkey')}, '].')"
_RUNS = "SELECT concat('SRC', cast(s_nationkey AS varchar(4))) AS ticker, concat('reports/r', cast(s_suppkey AS varchar(20)), '/') AS folder, s_acctbal AS balance, cast(s_suppkey AS varchar(20)) AS k FROM {supplier}"
_REPORT = "concat('<a href=\"#ref-1\">1</a>', CASE WHEN balance > 6000 THEN ' <a href=\"#ref-2\">2</a> [^p' || k || ']' ELSE '' END, ' ![a](a.png)', CASE WHEN balance < 1000 THEN ' ![b](a.png) ![c](c.png)' ELSE '' END)"
_MAP = f"concat({_OPEN}, '\"1\": \"p', k, '\"', {_SHUT})"
_CARD = f"concat({_OPEN}, '\"scenario_probabilities\": ', {_OPEN}, '\"a\": 0.5, \"b\": ', CASE WHEN balance < 3000 THEN '0.5' ELSE '0.25' END, {_SHUT}, CASE WHEN balance > 2000 THEN ', \"scenario_weighted_value\": 150' ELSE '' END, CASE WHEN balance > 4000 THEN ', \"fair_value\": ' || CASE WHEN balance > 7000 THEN '100.5' ELSE '149' END ELSE '' END, CASE WHEN balance > 8000 THEN ', \"reconciliation\": \"from 100.50 to more\"' ELSE '' END, {_SHUT})"
_VALUATION = "CASE WHEN balance > 9000 THEN 'So from 100.50 to more.' WHEN balance < 0 THEN 'A Scenario-weighted value.' ELSE 'Plain.' END"
_FILES = f"""WITH runs AS ({_RUNS})
  SELECT ticker, path, concat(CASE WHEN path = 'sources/d7.md' THEN '/elsewhere' ELSE ticker END, '/', path) AS resolved, text FROM (
    SELECT CASE WHEN lang = 'de' THEN source ELSE upper(source) END AS ticker, concat('sources/d', {_text('doc_id')}, '.md') AS path,
      concat('---', {_LINE}, 'kind: ', CASE WHEN lang = 'en' THEN 'news' WHEN lang = 'de' THEN 'blog' WHEN lang = 'fr' THEN 'research_answer' ELSE 'web_page' END, {_LINE}, CASE WHEN n_chars > 200 THEN concat('fetch_cmd: get', {_LINE}) ELSE '' END, '---', {_LINE}, coalesce(text, '')) AS text FROM {{documents}}
    UNION ALL SELECT {_TICKER}, concat(CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'derived/p' ELSE 'structured/p' END, {_text('p_partkey')}, '.json'), {_ARTIFACT} FROM {{part}}
    UNION ALL SELECT {_TICKER}, concat('wiki/w', {_text('p_partkey')}, '.md'), {_WIKI} FROM {{part}}
    UNION ALL SELECT ticker, concat(folder, 'report.md'), {_REPORT} FROM runs UNION ALL SELECT ticker, concat(folder, 'citation_map.json'), {_MAP} FROM runs WHERE balance > 0
    UNION ALL SELECT ticker, concat(folder, 'verdict.json'), {_CARD} FROM runs UNION ALL SELECT ticker, concat(folder, 'sections/valuation.md'), {_VALUATION} FROM runs WHERE balance < 9500) f"""


def _of(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


_SHAPES = " UNION ALL ".join(
    [f"SELECT ticker, path, 'producer-shape' AS code, '{p} without {f}' AS detail FROM art WHERE producer = '{p}' AND coalesce(json_extract_string(j, '$._meta.{f}'), '') = ''" for p, fields in NEEDS.items() for f in fields]
    + [f"SELECT ticker, path, 'producer-shape', '{p} with url' FROM art WHERE producer = '{p}' AND url <> ''" for p in ("compute", "model")]
    + [f"SELECT ticker, path, 'producer-shape', '{p} without derived_from' FROM art WHERE producer = '{p}' AND json_array_length(j, '$._meta.derived_from') = 0" for p in ("compute", "model")]
)
_CARDS = """cards AS (
  SELECT c.ticker, c.path, c.text AS j, coalesce(v.text, '') AS said, cast(c.text->>'fair_value' AS DOUBLE) AS fair, cast(c.text->>'scenario_weighted_value' AS DOUBLE) AS weighted, coalesce(c.text->>'reconciliation', '') AS why,
    cast(c.text->>'$.scenario_probabilities.a' AS DOUBLE) + cast(c.text->>'$.scenario_probabilities.b' AS DOUBLE) AS total
  FROM files c LEFT JOIN files v ON v.ticker = c.ticker AND v.path = replace(c.path, 'verdict.json', 'sections/valuation.md') WHERE c.path LIKE 'reports/%/verdict.json'),
apart AS (SELECT * FROM cards WHERE fair <> 0 AND abs(fair - weighted) / abs(fair) > 0.15)"""
_ALL = f"""WITH files AS ({plain(_FILES)}),
docs AS (SELECT *, regexp_extract(text, '^---\\n((?:.*\\n)*?)---\\n', 1) AS matter FROM files WHERE path LIKE 'sources/%'),
raw AS (SELECT *, CASE WHEN json_valid(text) THEN text END AS j FROM files WHERE path LIKE 'structured/%' OR path LIKE 'derived/%'),
art AS (SELECT *, j->>'$._meta.producer' AS producer, coalesce(j->>'$._meta.fetch_cmd', '') AS cmd, coalesce(j->>'$._meta.url', '') AS url, path LIKE 'structured/%' AS bronze FROM raw WHERE (j->'data') IS NOT NULL),
known AS (SELECT ticker, id, min(layer) AS layer FROM (SELECT ticker, regexp_extract(path, '([^/]+)\\.(?:md|json)$', 1) AS id, CASE WHEN path LIKE 'derived/%' THEN 'silver' ELSE 'bronze' END AS layer FROM files WHERE path LIKE 'sources/%' OR path LIKE 'structured/%' OR path LIKE 'derived/%') GROUP BY ALL),
pages AS (SELECT * FROM files WHERE path LIKE 'wiki/%' OR path LIKE 'reports/%/sections/%'),
reports AS (SELECT r.ticker, r.path, r.text, m.text AS map, list_distinct(regexp_extract_all(r.text, '{ANCHOR}', 1) || regexp_extract_all(r.text, '{CITATION}', 1)) AS cited FROM files r LEFT JOIN files m ON m.ticker = r.ticker AND m.path = replace(r.path, 'report.md', 'citation_map.json') WHERE r.path LIKE '%/report.md'),
led AS (SELECT ticker, path, c AS shown, CASE WHEN regexp_full_match(c, '[0-9]+') THEN map->>c ELSE c END AS id FROM (SELECT *, unnest(cited) AS c FROM reports WHERE map IS NOT NULL)),
refs AS (
  SELECT DISTINCT 4 AS n, ticker, path, unnest(regexp_extract_all(text, '{CITATION}', 1)) AS id, id AS shown FROM pages
  UNION ALL SELECT 5, ticker, path, id, shown FROM led WHERE id IS NOT NULL
  UNION ALL SELECT DISTINCT 9, ticker, path, unnest(from_json(j->'$._meta.derived_from', '["VARCHAR"]')) AS id, id FROM art
  UNION ALL SELECT 9, ticker, path, unnest(regexp_extract_all(text, '(?m)^- (?:id: )?([pd][0-9]+)$', 1)) AS id, id FROM pages),
{_CARDS},
found AS (
  SELECT DISTINCT 1 AS "check", ticker, '' AS path, 'path-containment' AS code, 'name of the ticker' AS detail FROM files WHERE ticker <> '_MACRO' AND NOT regexp_full_match(ticker, '[A-Z][A-Z0-9.-]{{0,9}}')
  UNION ALL SELECT 1, ticker, path, 'path-containment', 'outside the folder' FROM files WHERE NOT starts_with(resolved, ticker || '/')
  UNION ALL SELECT 2, ticker, path, 'producer-shape', 'no _meta or data' FROM raw WHERE j IS NULL OR (j->'data') IS NULL
  UNION ALL SELECT 2, ticker, path, 'layer-boundary', 'model output under structured' FROM art WHERE bronze AND producer = 'model'
  UNION ALL SELECT 2, ticker, path, 'producer-shape', 'unknown producer' FROM art WHERE producer NOT IN ({_of(NEEDS)})
  UNION ALL SELECT 2, * FROM ({_SHAPES})
  UNION ALL SELECT 2, ticker, path, unnest(['producer-shape', 'fetch-cmd']), 'model with fetch_cmd' FROM art WHERE producer = 'model' AND cmd <> ''
  UNION ALL SELECT 2, ticker, path, 'fetch-cmd', CASE WHEN bronze THEN 'bronze' ELSE 'silver' END || ' without fetch_cmd' FROM art WHERE producer IN ('fetch', 'compute') AND cmd = ''
  UNION ALL SELECT 3, ticker, path, 'layer-boundary', 'model kind' FROM docs WHERE regexp_extract(matter, '(?m)^kind: (.*)$', 1) IN ({_of(MODEL_KINDS)})
  UNION ALL SELECT 3, ticker, path, 'layer-boundary', 'unknown kind' FROM docs WHERE regexp_extract(matter, '(?m)^kind: (.*)$', 1) NOT IN ({_of((*MODEL_KINDS, *SOURCE_KINDS))})
  UNION ALL SELECT 3, ticker, path, 'fetch-cmd', 'source without fetch_cmd' FROM docs WHERE NOT contains(matter, 'fetch_cmd: get')
  UNION ALL SELECT 5, ticker, path, 'citation-unresolved', 'no citation_map.json' FROM reports WHERE map IS NULL
  UNION ALL SELECT 5, ticker, path, 'citation-unresolved', 'not in the map: ' || shown FROM led WHERE id IS NULL
  UNION ALL SELECT n, r.ticker, path, CASE n WHEN 9 THEN 'derivation-unresolved' ELSE 'citation-unresolved' END, coalesce(k.layer, s.layer, 'missing') || ': ' || shown
    FROM refs r LEFT JOIN known k ON k.ticker = r.ticker AND k.id = r.id LEFT JOIN known s ON s.ticker = '_MACRO' AND s.id = r.id WHERE CASE n WHEN 9 THEN coalesce(k.layer, s.layer) IS NULL ELSE coalesce(k.layer, s.layer, 'missing') <> 'bronze' END
  UNION ALL SELECT 6, ticker, path, 'exhibit-duplicated', i FROM (SELECT ticker, path, unnest(regexp_extract_all(text, '!\\[[^\\]\\n]*\\]\\(([^)\\n]+)\\)', 1)) AS i FROM reports) GROUP BY ticker, path, i HAVING count(*) > 1
  UNION ALL SELECT 7, ticker, path, 'citation-unlinked', len(list_distinct(regexp_extract_all(text, '\\[\\^[^\\]\\s]+\\]'))) || ' markers' FROM reports WHERE contains(text, '[^')
  UNION ALL SELECT 8, ticker, path, 'verdict-unreconciled', 'probabilities don''t add up to 1' FROM cards WHERE abs(total - 1) > 0.01
  UNION ALL SELECT 8, ticker, path, 'verdict-unreconciled', 'weighted value only in the text' FROM cards WHERE weighted IS NULL AND said LIKE '%Scenario-weighted%'
  UNION ALL SELECT 8, ticker, path, 'verdict-unreconciled', 'weighted value without fair value' FROM cards WHERE weighted IS NOT NULL AND coalesce(fair, 0) = 0
  UNION ALL SELECT 8, ticker, path, 'verdict-unreconciled', CASE WHEN why = '' THEN 'no reconciliation' ELSE 'short reconciliation' END FROM apart
  UNION ALL SELECT 8, ticker, path, 'verdict-unreconciled', 'reconciliation without scenario_weighted_value' FROM apart WHERE why <> ''
  UNION ALL SELECT 8, ticker, path, 'verdict-unreconciled', 'reconciliation not in the section' FROM apart WHERE why <> '' AND NOT contains(said, why)
  UNION ALL SELECT 10, ticker, path, 'secret', name FROM files, (VALUES {', '.join("('" + n.replace("'", "''") + "', $re$" + p + "$re$)" for n, p in SECRETS.items())}) s(name, pattern) WHERE regexp_matches(text, pattern)
  UNION ALL SELECT 11, ticker, path, 'secret', 'names token' FROM art WHERE json_extract_string(j, '$._meta.request.params[0][0]') = 'token')"""


def _corpus(t: Tables):
    return rows(t, _FILES)


@query("L04_findings", f"""{_ALL} SELECT "check", ticker, path, 'error' AS severity, code, detail FROM found""")
def all_findings(t: Tables):
    return validate(_corpus(t))


@query("N03_recorded_requests", f"""WITH files AS ({plain(_FILES)}), art AS (SELECT ticker, path, text FROM files WHERE (path LIKE 'structured/%' OR path LIKE 'derived/%') AND json_valid(text) AND (text->'data') IS NOT NULL)
  SELECT art.ticker, art.path, 'names ' || coalesce(nullif(CASE WHEN t.type = 'ARRAY' AND json_array_length(t.value) = 2 THEN t.value->>'$[0]' END, ''), t.key) AS detail FROM art, json_tree(art.text, '$._meta.request') t
  WHERE lower(t.key) IN ('token', 'apikey', 'api_key', 'access_token') OR t.type = 'ARRAY' AND json_array_length(t.value) = 2 AND lower(t.value->>'$[0]') IN ('token', 'apikey', 'api_key', 'access_token')""")
def recorded_requests(t: Tables):
    return validate(_corpus(t)).where("check = 11").select("ticker", "path", "detail")


@query("N02_verdict_gate", f"""{_ALL} SELECT ticker, path, detail FROM found WHERE "check" = 8""")
def verdict_gate(t: Tables):
    return validate(_corpus(t)).where("check = 8").select("ticker", "path", "detail")


@query("L04_by_code", f"""{_ALL} SELECT "check", code, count(*) AS findings, count(DISTINCT ticker || '/' || path) AS files FROM found GROUP BY ALL""")
def by_code(t: Tables):
    found = validate(_corpus(t))
    return found.groupBy("check", "code").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(F.concat("ticker", F.lit("/"), "path")).alias("files"))
