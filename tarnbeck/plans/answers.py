"""Closing questions: customers' orders are questions, their lines' parts the evidence of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import answers as W
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows

_LEDGER = "SELECT o_custkey AS qhash, CASE WHEN max(o_totalprice) > 300000 THEN 'deferred' ELSE 'open' END AS status FROM {orders} WHERE o_orderpriority <> '1-URGENT' GROUP BY o_custkey"
#: An order is an answer to its customer's question, its lines are the sources it names.
_ANSWERS = "SELECT o_custkey AS qhash, o_orderkey AS ord, o_orderdate AS at_, l_linenumber AS pos, l_partkey AS id FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey AND l_returnflag <> 'N' WHERE o_orderstatus = 'F'"
_OWN = "SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'silver' ELSE 'bronze' END AS layer, s.stamp FROM {part} JOIN (SELECT l_partkey, max(l_shipdate) AS stamp FROM {lineitem} GROUP BY l_partkey) s ON s.l_partkey = p_partkey WHERE p_size < 47"
_SHARED = "SELECT p_partkey AS id, CASE WHEN p_type = 'SMALL' THEN 'silver' ELSE 'bronze' END AS layer, cast(date '2024-01-01' AS timestamp) AS stamp FROM {part} WHERE p_size > 40"
_SQL = f"""WITH ledger AS ({plain(_LEDGER)}), named AS ({plain(_ANSWERS)}), own AS ({plain(_OWN)}), shared AS (SELECT * FROM ({plain(_SHARED)}) WHERE layer = 'bronze'),
looked AS (SELECT n.*, coalesce(o.layer, s.layer, 'missing') AS layer, CASE WHEN o.id IS NULL THEN s.stamp ELSE o.stamp END AS stamp FROM named n LEFT JOIN own o ON o.id = n.id LEFT JOIN shared s ON s.id = n.id),
judged AS (SELECT qhash, ord, CASE WHEN qhash NOT IN (SELECT qhash FROM ledger) THEN 'unknown question' WHEN count(id) = 0 THEN 'no sources' ELSE arg_min(CASE layer WHEN 'silver' THEN 'silver: ' ELSE 'not found: ' END || id, (pos, id)) FILTER (layer <> 'bronze') END AS problem FROM looked GROUP BY qhash, ord),
taken AS (SELECT l.* FROM looked l JOIN judged j ON j.ord = l.ord WHERE problem IS NULL),
firsts AS (SELECT qhash, id, min((ord, pos, id)) AS p, min(stamp) AS stamp FROM taken GROUP BY ALL)"""


def _inputs(t: Tables):
    pairs = rows(t, _ANSWERS).groupBy("qhash", "ord").agg(F.min("at_").alias("at"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("named"))
    asked = pairs.select("qhash", "ord", "at", F.transform("named", lambda n: n["id"]).alias("sources"), F.array(F.concat(F.lit("answer "), F.col("ord").cast("string"))).alias("artifacts"))
    ledger = rows(t, _LEDGER).select("qhash", "status", F.lit(None).cast("timestamp").alias("answered_at"), F.array().cast("array<struct<id: bigint, stamp: timestamp>>").alias("sources"), F.array().cast("array<string>").alias("artifacts"))
    return ledger, asked, rows(t, _OWN), rows(t, _SHARED)


@query("L07_mark_answered", f"""{_SQL} SELECT l.qhash, CASE WHEN t.qhash IS NULL THEN l.status ELSE 'answered' END AS status, t.answered_at, coalesce(s.sources, '') AS sources, coalesce(t.artifacts, '') AS artifacts FROM ledger l
  LEFT JOIN (SELECT qhash, arg_max(at_, ord) AS answered_at, string_agg(DISTINCT 'answer ' || ord, ',' ORDER BY ord) AS artifacts FROM taken GROUP BY qhash) t ON t.qhash = l.qhash
  LEFT JOIN (SELECT qhash, string_agg(id || '@' || strftime(stamp, '%Y-%m-%d'), ',' ORDER BY p) AS sources FROM firsts GROUP BY qhash) s ON s.qhash = l.qhash""".replace("string_agg(DISTINCT 'answer ' || ord, ',' ORDER BY ord)", "array_to_string(list_transform(list_sort(list_distinct(list(ord))), lambda o: 'answer ' || o), ',')"))
def mark_answered(t: Tables):
    out = W.mark_answered(*_inputs(t))
    sources = F.array_join(F.transform("sources", lambda s: F.concat(s["id"].cast("string"), F.lit("@"), F.date_format(s["stamp"], "yyyy-MM-dd"))), ",")
    return out.select("qhash", "status", "answered_at", sources.alias("sources"), F.array_join("artifacts", ",").alias("artifacts"))


@query("L07_refused_answers", f"{_SQL} SELECT qhash, ord, problem FROM judged WHERE problem IS NOT NULL")
def refused_answers(t: Tables):
    return W.refused(*_inputs(t))


_DROPS = "SELECT c_custkey AS qhash FROM {customer} WHERE c_acctbal < 0"


@query("L07_drop_question", f"SELECT qhash, CASE WHEN qhash IN (SELECT qhash FROM ({plain(_DROPS)})) THEN 'dropped' ELSE status END AS status FROM ({plain(_LEDGER)})")
def drop_question(t: Tables):
    return W.drop_questions(rows(t, _LEDGER), rows(t, _DROPS))
