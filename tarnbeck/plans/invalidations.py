"""Invalidation over the trade tables: parts are evidence, orders questions, customers pages, suppliers derived entries."""

from __future__ import annotations

from tarnbeck.operators.invalidation import Invalidation, applied
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows

#: A part takes the place of the one before it that has its brand, type and size.
_SOURCES = "SELECT p_partkey AS id, lag(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS supersedes FROM {part}"
_ARTIFACTS = "SELECT p_partkey AS id, CASE WHEN p_size <= 45 THEN p_brand END AS kind, p_partkey AS ord, s.stamp FROM {part} LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS stamp FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_partkey) s ON s.l_partkey = p_partkey"
_QUESTIONS = "SELECT o_orderkey AS hash, n_name AS section, CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'P' THEN 'deferred' ELSE 'open' END AS status, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS answered_at, o_orderkey AS ord FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey"
#: A nation's suppliers sell much of a brand: its section subscribes to it.
_SUBSCRIPTIONS = "SELECT section, kind FROM (SELECT n_name AS section, p_brand AS kind, rank() OVER (PARTITION BY n_name ORDER BY sum(cast(l_quantity AS DECIMAL(18,2))) DESC) AS r FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey JOIN {part} ON p_partkey = l_partkey GROUP BY n_name, p_brand) b WHERE r <= 2"
_PAGES = "SELECT c_custkey AS page, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS section, c_custkey AS ord FROM {customer}"
_TAKEN = "CASE WHEN l_linestatus = 'O' THEN l_shipdate END"
_REFERENCES = f"""SELECT 'question' AS level, l_orderkey AS key, cast(l_linenumber AS bigint) AS ord, l_partkey AS id, {_TAKEN} AS stamp FROM {{lineitem}}
  UNION ALL SELECT 'page', o_custkey, l_orderkey * 10 + l_linenumber, l_partkey, {_TAKEN} FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber = 1
  UNION ALL SELECT 'derived', l_suppkey, l_orderkey * 10 + l_linenumber, l_partkey, {_TAKEN} FROM {{lineitem}} WHERE l_returnflag = 'R'"""


def _plan(t: Tables) -> Invalidation:
    return Invalidation(rows(t, _SOURCES), rows(t, _ARTIFACTS), rows(t, _QUESTIONS), rows(t, _SUBSCRIPTIONS), rows(t, _PAGES), rows(t, _REFERENCES))


_SQL = f"""WITH sources AS ({plain(_SOURCES)}), artifacts AS ({plain(_ARTIFACTS)}), questions AS ({plain(_QUESTIONS)}), subs AS ({plain(_SUBSCRIPTIONS)}), pages AS ({plain(_PAGES)}), refs AS ({plain(_REFERENCES)}),
gone AS (SELECT DISTINCT supersedes AS id FROM sources WHERE supersedes IS NOT NULL),
stale AS (SELECT r.level, key, r.ord, r.id, r.id NOT IN (SELECT id FROM gone) AS newer FROM refs r LEFT JOIN artifacts a ON a.id = r.id WHERE r.id IN (SELECT id FROM gone) OR a.stamp > r.stamp),
first AS (SELECT * FROM stale QUALIFY row_number() OVER (PARTITION BY level, key ORDER BY ord, id) = 1),
came AS (SELECT hash, arg_min(a.id, a.ord) AS evidence FROM questions q JOIN subs s ON s.section = q.section JOIN artifacts a ON a.kind = s.kind AND (a.stamp > answered_at OR status = 'deferred' OR answered_at IS NULL) AND a.stamp IS NOT NULL GROUP BY hash),
causes AS (
  SELECT q.hash, section, status, q.ord AS spot, 'dependency' AS cause, f.id AS evidence, newer AS is_new FROM questions q JOIN first f ON f.level = 'question' AND f.key = q.hash WHERE status = 'answered'
  UNION ALL SELECT q.hash, section, status, q.ord, 'subscription', c.evidence, true FROM questions q JOIN came c ON c.hash = q.hash WHERE status = 'deferred' OR status = 'answered' AND q.hash NOT IN (SELECT key FROM first WHERE level = 'question')),
dirty AS (SELECT page, section, p.ord AS spot, id AS evidence, newer FROM pages p JOIN first f ON f.level = 'page' AND f.key = p.page),
fresh AS (SELECT id, min((level, spot)) AS m FROM (
  SELECT id, 0 AS level, 0::BIGINT AS spot FROM sources WHERE supersedes IS NOT NULL UNION ALL SELECT evidence, 1, spot FROM causes WHERE is_new
  UNION ALL SELECT evidence, 2, spot FROM dirty WHERE newer UNION ALL SELECT id, 3, ord FROM stale WHERE level = 'derived' AND newer) GROUP BY id)"""
_REOPENED = "SELECT hash, section, cause, evidence FROM causes WHERE status = 'answered'"


@query("L05_reopened_questions", f"{_SQL} {_REOPENED}")
def reopened_questions(t: Tables):
    return _plan(t).reopened()


@query("L05_revived_questions", f"{_SQL} SELECT hash FROM causes WHERE status = 'deferred'")
def revived_questions(t: Tables):
    return _plan(t).revived()


@query("L05_dirty_pages", f"{_SQL} SELECT page, section, spot AS \"at\", evidence, newer FROM dirty")
def dirty_pages(t: Tables):
    return _plan(t).dirty_pages()


@query("L05_dirty_sections", f"{_SQL} SELECT section, min(spot) AS \"at\" FROM dirty WHERE section IS NOT NULL GROUP BY section")
def dirty_sections(t: Tables):
    return _plan(t).dirty_sections()


@query("L05_new_evidence", f"{_SQL} SELECT id, m[1] AS level, m[2] AS \"at\" FROM fresh")
def new_evidence(t: Tables):
    return _plan(t).new_evidence()


@query("L05_invalidate", f"""{_SQL} SELECT 'reopened' AS output, cast(hash AS VARCHAR) AS key, section, cause, cast(evidence AS VARCHAR) AS evidence FROM ({_REOPENED})
  UNION ALL SELECT 'revived', cast(hash AS VARCHAR), NULL, NULL, NULL FROM causes WHERE status = 'deferred' UNION ALL SELECT 'dirty page', cast(page AS VARCHAR), section, 'dependency', cast(evidence AS VARCHAR) FROM dirty
  UNION ALL SELECT DISTINCT 'dirty section', section, section, NULL, NULL FROM dirty WHERE section IS NOT NULL UNION ALL SELECT 'new evidence', cast(id AS VARCHAR), NULL, NULL, NULL FROM fresh""")
def invalidate(t: Tables):
    return _plan(t).report()


@query("L05_applied", f"{_SQL} SELECT q.hash, CASE WHEN c.hash IS NULL THEN q.status WHEN q.status = 'answered' THEN 'reopened' ELSE 'open' END AS status FROM questions q LEFT JOIN causes c ON c.hash = q.hash")
def applied_plan(t: Tables):
    return applied(rows(t, _QUESTIONS), _plan(t))
