"""Queries over the gates: validation, lints, ledger writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import gates as G
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows

_KINDS = "SELECT doc_id AS id, CASE WHEN source IN ('src1', 'src4') THEN 'research_answer' WHEN source IN ('src2', 'src5') THEN 'sec_filing' WHEN source = 'src3' THEN NULL WHEN lang = 'de' THEN 'blog' ELSE 'news' END AS kind FROM {documents}"
_SOURCE_KINDS = ", ".join(f"'{k}'" for k in G.SOURCE_KINDS)


@query("C02_layer_boundary", f"SELECT id, CASE WHEN kind = 'research_answer' THEN 'model kind' ELSE 'unknown kind' END AS problem FROM ({plain(_KINDS)}) WHERE coalesce(kind, '') NOT IN ({_SOURCE_KINDS})")
def layer_boundary(t: Tables):
    from tarnbeck.operators.findings import findings

    return findings(rows(t, _KINDS), ["id"], G.layer_problems())


_MADE = "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'model' WHEN '2-HIGH' THEN 'compute' ELSE 'fetch' END AS producer, CASE WHEN o_orderstatus = 'F' THEN 'get' WHEN o_orderstatus = 'P' THEN '' END AS fetch_cmd, o_totalprice > 100000 AS bronze FROM {orders}"


@query("C03_fetch_commands", f"SELECT * FROM (SELECT id, CASE WHEN producer = 'model' THEN CASE WHEN coalesce(fetch_cmd, '') <> '' THEN 'model with fetch_cmd' END WHEN coalesce(fetch_cmd, '') = '' THEN CASE WHEN bronze THEN 'bronze without fetch_cmd' ELSE 'silver without fetch_cmd' END END AS problem FROM ({plain(_MADE)})) WHERE problem IS NOT NULL")
def fetch_commands(t: Tables):
    return rows(t, _MADE).select("id", G.command_problem(F.col("producer"), F.col("fetch_cmd"), F.col("bronze")).alias("problem")).where("problem is not null")


_NAMES = "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN upper(p_type) WHEN p_size < 20 THEN substring(p_brand, 1, 5) WHEN p_size < 30 THEN upper(substring(p_brand, 1, 5)) || '.' || p_size WHEN p_size < 40 THEN '../' || p_size WHEN p_size < 45 THEN '_MACRO' ELSE '..' END AS name FROM {part}"


@query("C04_names", f"SELECT id, name = '_MACRO' OR regexp_matches(name, '{G.TICKER}') AS ticker, NOT (contains(name, '/') OR contains(name, '\\') OR name IN ('', '.', '..')) AS inside FROM ({plain(_NAMES)})")
def names(t: Tables):
    return rows(t, _NAMES).select("id", G.good_ticker(F.col("name")).alias("ticker"), G.bare_name(F.col("name")).alias("inside"))


_KINDED = "SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'page' WHEN 'de' THEN 'summary' WHEN 'fr' THEN 'filing' ELSE 'note' END AS kind, text AS body FROM {documents}"


@query("C09_long_enough", f"SELECT id, CASE kind WHEN 'page' THEN n >= 400 WHEN 'summary' THEN n >= 100 WHEN 'filing' THEN n >= 50 ELSE true END AS kept FROM (SELECT id, kind, length(regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g')) AS n FROM ({plain(_KINDED)}))")
def long_enough(t: Tables):
    return rows(t, _KINDED).select("id", G.long_enough(F.col("kind"), F.col("body")).alias("kept"))


_DRAFTS = "SELECT doc_id AS id, source AS section, text || ' [^s' || doc_id || '] and [^t.1]' AS body FROM {documents}"
_BEFORE = "SELECT doc_id AS id, source AS section, regexp_replace(text, '^[^a-z]*[a-z]+ ', '') AS body FROM {documents} WHERE lang <> 'fr'"
_WORDS = "len(list_filter(regexp_split_to_array(coalesce(body, ''), '\\s+'), lambda w: w <> ''))"


@query("C19_prose_length", f"SELECT id, length(regexp_replace(body, '{T.CITATION}', '', 'g')) - 1500 AS excess FROM ({plain(_DRAFTS)}) WHERE length(regexp_replace(body, '{T.CITATION}', '', 'g')) > 1500")
def prose_length(t: Tables):
    return rows(t, _DRAFTS).select("id", G.prose_excess(F.col("body"), 1500).alias("excess")).where("excess is not null")


def _budget_sql(keys: str, factor: str) -> str:
    return f"WITH m AS (SELECT {keys}, cast(sum({_WORDS}) AS BIGINT) AS words FROM ({plain(_DRAFTS)}) GROUP BY {keys}), b AS (SELECT {keys}, cast(floor(sum({_WORDS}) * {factor}) AS BIGINT) AS budget FROM ({plain(_BEFORE)}) GROUP BY {keys}) SELECT {keys}, words, budget FROM m LEFT JOIN b USING ({keys}) WHERE budget IS NULL OR words > budget"


@query("C21_section_budget", _budget_sql("id", "1.03::DOUBLE"))
def section_budget(t: Tables):
    return G.over_budget(rows(t, _DRAFTS), rows(t, _BEFORE), 1.03, ["id"])


@query("C21_report_budget", _budget_sql("section", "1.25::DOUBLE"))
def report_budget(t: Tables):
    return G.over_budget(rows(t, _DRAFTS), rows(t, _BEFORE), 1.25, ["section"])


_RENDERED = "SELECT page_id AS id, html || replace(replace(CASE WHEN length(html) > 2500 THEN '<style>p « color: red; »</style><p>/* left */ «« price »» @media --navy: #0f2942; « font-size: .72em; »</p>' WHEN length(html) > 1500 THEN '<style>.a « width: 1px; »<p>«% for x %» «« a »» ««  a »» «« b »» «« c »» «« d »»</p>' ELSE '' END, '«', chr(123)), '»', chr(125)) AS html FROM {pages}"
_SEEN = "regexp_replace(regexp_replace(html, '(?is)<(?:style|script)\\b[^>]*>.*?</(?:style|script)\\s*>', '', 'g'), '(?s)</?[a-zA-Z][^>]*>', '', 'g')"
_CUT = "list_transform(regexp_extract_all(seen, '(?is){p}'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
_FOUND = " UNION ALL ".join(f"SELECT id, '{n}' AS rule, unnest(list_slice(list_distinct_in_order, 1, 3)) AS excerpt FROM (SELECT id, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS list_distinct_in_order FROM (SELECT id, list_transform({_CUT.replace('{p}', p)}, lambda x: CASE WHEN length(x) > 90 THEN substring(x, 1, 89) || '…' ELSE x END) AS xs FROM v))" for n, p in G.MACHINERY.items())


@query("C23_visible_machinery", f"WITH r AS ({plain(_RENDERED)}), v AS (SELECT id, {_SEEN} AS seen FROM r) {_FOUND} UNION ALL SELECT id, 'unbalanced style', o || ' ' || c FROM (SELECT id, len(regexp_extract_all(html, '(?i)<style\\b')) AS o, len(regexp_extract_all(html, '(?i)</style\\b')) AS c FROM r) WHERE o <> c")
def visible_machinery(t: Tables):
    return G.machinery(rows(t, _RENDERED))


_CITING = "SELECT doc_id AS id, coalesce(text, '') || ' [^c' || doc_id || '] then [^o' || length(text) || '] and [^c' || doc_id || ']' AS body FROM {documents}"
_OWN = "SELECT 'c' || c_custkey AS artifact, CASE WHEN c_mktsegment = 'BUILDING' THEN 'silver' ELSE 'bronze' END AS layer FROM {customer} WHERE c_acctbal > 0"
_SHARED = "SELECT 'o' || p_partkey AS artifact, CASE WHEN p_size > 40 THEN 'silver' ELSE 'bronze' END AS layer FROM {part}"
_LAYER = "coalesce(a.layer, s.layer, 'missing')"
_UNRESOLVED = f"SELECT id, cid, {_LAYER} AS layer FROM (SELECT DISTINCT id, unnest(regexp_extract_all(body, '{T.CITATION}', 1)) AS cid FROM ({plain(_CITING)})) c LEFT JOIN ({plain(_OWN)}) a ON a.artifact = cid LEFT JOIN ({plain(_SHARED)}) s ON s.artifact = cid WHERE {_LAYER} <> 'bronze'"


@query("D02_unresolved_citations", _UNRESOLVED)
def unresolved(t: Tables):
    return G.unresolved_citations(rows(t, _CITING), rows(t, _OWN), rows(t, _SHARED))


_REPORTS = "SELECT o_orderkey AS id, 'a <a href=\"#ref-1\">1</a> b <a href=\"#ref-' || length(o_orderpriority) || '\">x</a> <a href=\"#ref-1\">1</a> [^c' || o_custkey || ']' AS body FROM {orders}"
_MAPS = "SELECT l_orderkey AS id, cast(l_linenumber AS varchar(9)) AS number, CASE WHEN l_returnflag = 'R' THEN 'o' || l_partkey ELSE 'c' || l_suppkey END AS artifact FROM {lineitem} WHERE l_linestatus = 'F'"


@query("D03_report_citations", f"""WITH c AS (SELECT DISTINCT id, unnest(list_concat(regexp_extract_all(body, '{G.ANCHOR}', 1), regexp_extract_all(body, '{T.CITATION}', 1))) AS cid FROM ({plain(_REPORTS)})), m AS (SELECT * FROM ({plain(_MAPS)})), w AS (SELECT DISTINCT id FROM m),
  n AS (SELECT c.id, cid, regexp_full_match(cid, '[0-9]+') AS num, m.artifact AS target FROM c JOIN w ON w.id = c.id LEFT JOIN m ON m.id = c.id AND m.number = cid)
  SELECT DISTINCT id, NULL AS cid, 'no map' AS problem FROM c WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, cid, 'not in the map' FROM n WHERE num AND target IS NULL
  UNION ALL SELECT id, cid, {_LAYER} FROM (SELECT id, cid, CASE WHEN num THEN target ELSE cid END AS x FROM n WHERE NOT num OR target IS NOT NULL) LEFT JOIN ({plain(_OWN)}) a ON a.artifact = x LEFT JOIN ({plain(_SHARED)}) s ON s.artifact = x WHERE {_LAYER} <> 'bronze'""")
def report_citations(t: Tables):
    return G.report_citations(rows(t, _REPORTS), rows(t, _MAPS), rows(t, _OWN), rows(t, _SHARED))


_BUILT = "SELECT l_orderkey AS carrier, CASE WHEN l_returnflag = 'A' THEN 'c' || l_suppkey ELSE 'o' || l_partkey END AS ref FROM {lineitem}"


@query("D05_invalid_built_from", f"SELECT DISTINCT carrier, ref FROM ({plain(_BUILT)}) WHERE ref NOT IN (SELECT artifact FROM ({plain(_OWN)}) UNION ALL SELECT artifact FROM ({plain(_SHARED)}))")
def invalid_built_from(t: Tables):
    from tarnbeck.operators.provenance import unresolved as missing

    return missing(rows(t, _BUILT), rows(t, _OWN).union(rows(t, _SHARED)))


_STATE = "SELECT n_name AS kind, 'c' || c_custkey AS current_id FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_acctbal > CASE WHEN n_regionkey = 1 THEN 0 ELSE -500 END"


@query("D07_missing_artifacts", f"SELECT DISTINCT kind FROM ({plain(_STATE)}) WHERE current_id NOT IN (SELECT artifact FROM ({plain(_OWN)}))")
def missing_artifacts(t: Tables):
    return G.missing_kinds(rows(t, _STATE), rows(t, _OWN))


_URLS = "SELECT o_custkey AS answer, 'u' || o_orderpriority AS url FROM {orders}"
_URL_MAP = "SELECT DISTINCT o_custkey AS answer, 'u' || o_orderpriority AS url, CASE WHEN o_orderpriority <> '5-LOW' THEN 's' END AS source FROM {orders} WHERE o_orderstatus <> 'P'"


@query("D16_harvest_targets", f"SELECT DISTINCT answer FROM ({plain(_URLS)}) u WHERE NOT EXISTS (SELECT 1 FROM ({plain(_URL_MAP)}) m WHERE m.answer = u.answer AND m.url = u.url AND m.source IS NOT NULL)")
def harvest_targets(t: Tables):
    return G.harvest_targets(rows(t, _URLS), rows(t, _URL_MAP), retry_failed=True)


_LEDGER = "SELECT role AS section, text AS question FROM {conversations} WHERE turn = 0"
_NEW = "SELECT conv_id * 1000 + turn AS ord, role AS section, CASE WHEN turn = 1 THEN '  ' || text ELSE text END AS question FROM {conversations}"
_HASH = "substring(sha1(section || '|' || lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g'))), 1, 10)"


@query("I02_question_hash", "SELECT conv_id, turn, substring(sha1(role || '|' || lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 1, 10) AS qhash FROM conversations")
def question_hash(t: Tables):
    return t("conversations").select("conv_id", "turn", T.question_hash(F.col("role"), F.col("text")).alias("qhash"))


_ADDED = f"SELECT arg_min(section, (ord, regexp_replace(question, '^\\s+|\\s+$', '', 'g'))) AS section, arg_min(regexp_replace(question, '^\\s+|\\s+$', '', 'g'), (ord, regexp_replace(question, '^\\s+|\\s+$', '', 'g'))) AS question, {_HASH} AS qhash FROM ({plain(_NEW)}) WHERE regexp_replace(question, '^\\s+|\\s+$', '', 'g') <> '' AND {_HASH} NOT IN (SELECT {_HASH} FROM ({plain(_LEDGER)})) GROUP BY {_HASH}"


@query("L07_add_questions", _ADDED)
def add_questions(t: Tables):
    return G.added(rows(t, _LEDGER), rows(t, _NEW))


@query("E08_ledger_counts", f"WITH k AS (SELECT count(DISTINCT {_HASH}) AS n FROM ({plain(_LEDGER)})) SELECT (SELECT count(*) FROM ({_ADDED})) AS added, (SELECT count(*) FROM ({_ADDED})) + n AS total FROM k")
def ledger_counts(t: Tables):
    new = G.added(rows(t, _LEDGER), rows(t, _NEW)).agg(F.count(F.lit(1)).alias("added"))
    old = rows(t, _LEDGER).agg(F.count_distinct(T.question_hash(F.col("section"), F.col("question"))).alias("n"))
    return new.crossJoin(old).select("added", (F.col("added") + F.col("n")).alias("total"))


_STATUS = "SELECT c_custkey AS qhash, CASE WHEN c_acctbal > 5000 THEN 'open' WHEN c_acctbal > 2000 THEN 'reopened' WHEN c_acctbal > 0 THEN 'answered' ELSE 'dropped' END AS status, cast(floor(c_nationkey / 10) AS bigint) AS attempts FROM {customer}"
_TRIED = "SELECT o_custkey AS qhash FROM {orders} WHERE o_orderstatus = 'P'"


@query("L07_record_attempts", f"SELECT qhash, attempts + coalesce(k, 0) AS attempts, CASE WHEN k IS NOT NULL AND status IN ('open', 'reopened') AND attempts + k >= 3 THEN 'deferred' ELSE status END AS status FROM ({plain(_STATUS)}) LEFT JOIN (SELECT qhash, count(*) AS k FROM ({plain(_TRIED)}) GROUP BY qhash) USING (qhash)")
def record_attempts(t: Tables):
    return G.after_attempts(rows(t, _STATUS), rows(t, _TRIED))


_REOPENED = "SELECT DISTINCT o_custkey AS qhash FROM {orders} WHERE o_totalprice > 250000"
_REVIVED = "SELECT DISTINCT o_custkey AS qhash FROM {orders} WHERE o_totalprice < 20000"


@query("J05_apply_invalidation", f"SELECT qhash, CASE WHEN qhash IN (SELECT qhash FROM ({plain(_REVIVED)})) THEN 'open' WHEN qhash IN (SELECT qhash FROM ({plain(_REOPENED)})) THEN 'reopened' ELSE status END AS status FROM ({plain(_STATUS)})")
def apply_invalidation(t: Tables):
    once = G.applied(rows(t, _STATUS), rows(t, _REOPENED), rows(t, _REVIVED))
    return G.applied(once, rows(t, _REOPENED), rows(t, _REVIVED))


_DIRTY = "SELECT n_name AS section, n_nationkey AS ord FROM {nation} WHERE n_regionkey = 1"
_MARKS = "SELECT n_name AS section, c_custkey AS ord FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_acctbal > 9000"


@query("J06_dirty_sections", f"WITH b AS (SELECT section, 0 AS side, ord FROM ({plain(_DIRTY)}) UNION ALL SELECT section, 1, ord FROM ({plain(_MARKS)})) SELECT section, row_number() OVER (ORDER BY min((side, ord)), section) AS place FROM b GROUP BY section")
def dirty_sections(t: Tables):
    return G.dirty_sections(rows(t, _DIRTY), rows(t, _MARKS))


_RANKED = "SELECT o_custkey AS grp, max(o_orderdate) AS ranked_at FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey"
_CHANGED = "SELECT o_custkey AS grp, max(o_orderdate) AS changed_at FROM {orders} WHERE o_orderstatus <> 'F' GROUP BY o_custkey"


@query("J08_stale_rankings", f"SELECT r.grp, coalesce(ranked_at >= changed_at, ranked_at IS NOT NULL) AS usable FROM ({plain(_RANKED)}) r LEFT JOIN ({plain(_CHANGED)}) c ON c.grp = r.grp")
def stale_rankings(t: Tables):
    return G.stale_ranking(rows(t, _RANKED), rows(t, _CHANGED))


_REQUESTS = """SELECT c_custkey AS id, CASE WHEN c_acctbal > 6000 THEN '{"params": {"Token": "", "page": 1}, "body": [{"API_KEY": null}]}' WHEN c_acctbal > 3000 THEN '{"params": [["apikey", "x"], ["page", 2]], "key": 3}' WHEN c_acctbal > 0 THEN '{"params": ["access_token", ' || c_custkey || '], "note": "token"}' WHEN c_acctbal > -500 THEN '{"a": {"b": {"c": {"token": {"d": 1}}}}}' END AS request FROM {customer}"""


@query("C05_credential_keys", f"SELECT id, CASE WHEN request IS NULL THEN '' WHEN contains(request, 'Token') THEN 'API_KEY,Token' WHEN contains(request, 'apikey') THEN 'apikey' WHEN contains(request, 'access_token') THEN 'access_token' ELSE 'token' END AS keys FROM ({plain(_REQUESTS.replace('{\"', '<\"').replace('{customer}', '{customer}')).replace('<\"', '{\"')})")
def credential_keys(t: Tables):
    return t("customer").select(F.col("c_custkey").alias("id"), F.array_join(G.credential_names(_request(F.col("c_custkey"), F.col("c_acctbal"))), ",").alias("keys"))


def _request(key, balance):
    return (
        F.when(balance > 6000, F.lit('{"params": {"Token": "", "page": 1}, "body": [{"API_KEY": null}]}'))
        .when(balance > 3000, F.lit('{"params": [["apikey", "x"], ["page", 2]], "key": 3}'))
        .when(balance > 0, F.concat(F.lit('{"params": ["access_token", '), key, F.lit('], "note": "token"}')))
        .when(balance > -500, F.lit('{"a": {"b": {"c": {"token": {"d": 1}}}}}'))
    )


_ALL = f"SELECT 0 AS \"check\", cast(id AS VARCHAR) AS path, problem FROM (SELECT id, CASE WHEN kind = 'research_answer' THEN 'model kind' ELSE 'unknown kind' END AS problem FROM ({plain(_KINDS)}) WHERE coalesce(kind, '') NOT IN ({_SOURCE_KINDS})) UNION ALL SELECT 1, cast(id AS VARCHAR), cid || ' ' || layer FROM ({_UNRESOLVED}) UNION ALL SELECT 2, cast(carrier AS VARCHAR), ref FROM (SELECT DISTINCT carrier, ref FROM ({plain(_BUILT)}) WHERE ref NOT IN (SELECT artifact FROM ({plain(_OWN)}) UNION ALL SELECT artifact FROM ({plain(_SHARED)})))"


def _validated(t: Tables):
    path = lambda df, key, problem: df.select(F.col(key).cast("string").alias("path"), problem.alias("problem"))
    return G.ordered_union(
        path(layer_boundary(t), "id", F.col("problem")),
        path(unresolved(t), "id", F.concat_ws(" ", "cid", "layer")),
        path(invalid_built_from(t), "carrier", F.col("ref")),
    )


@query("H01_findings", _ALL)
def findings_in_order(t: Tables):
    return _validated(t)


@query("L04_validate", f"SELECT \"check\", count(*) AS findings, count(DISTINCT path) AS paths FROM ({_ALL}) GROUP BY ALL")
def validate(t: Tables):
    return _validated(t).groupBy("check").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("paths"))
