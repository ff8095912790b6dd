"""Queries over fetched pages, filings, harvests, candidates and the ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import findings as N
from tarnbeck.operators import harvest as H
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import DOCS, plain, rows

_META = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'compute' WHEN 2 THEN 'model' ELSE 'other' END AS producer, CASE WHEN o_orderkey % 3 <> 0 THEN 'get' END AS fetch_cmd,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS fetched_at, o_orderkey % 7 AS inputs FROM {orders}"""


@query("C01_producer_shapes", f"""WITH m AS ({plain(_META)}) SELECT id, 'fetch_cmd missing' AS problem FROM m WHERE producer = 'fetch' AND fetch_cmd IS NULL UNION ALL SELECT id, 'fetched_at missing' FROM m WHERE producer = 'fetch' AND fetched_at IS NULL
    UNION ALL SELECT id, 'derived_from missing' FROM m WHERE producer = 'compute' AND inputs = 0 UNION ALL SELECT id, 'fetch_cmd forbidden' FROM m WHERE producer = 'model' AND fetch_cmd IS NOT NULL UNION ALL SELECT id, 'unknown producer' FROM m WHERE producer = 'other'""")
def producer_shapes(t: Tables):
    metas = rows(t, _META).withColumn("derived_from", F.when(F.col("inputs") > 0, F.array(F.lit("x"))))
    return N.findings(metas, ["id"], N.producer_problems())


_FILED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN '2.0' || (o_orderkey % 4) || ',9.0' || (o_orderkey % 2) ELSE '' END AS items FROM {orders}"


@query("C08_material_filings", f"SELECT id FROM ({plain(_FILED)}) WHERE items = '' OR regexp_matches(items, '2\\.02|9\\.01')")
def material_filings(t: Tables):
    items = F.filter(F.split("items", ","), lambda x: x != "")
    return rows(t, _FILED).where(H.material(items, ["2.02", "9.01"])).select("id")


_ERRORS = [*N.ESCALATE, "http_403", "http_503", "mime_not_allowed", "too_large", "private", "pdf_empty", "loopback"]
_ERROR = f"CASE c_nationkey {' '.join(f'WHEN {i} THEN {x!r}' for i, x in enumerate(_ERRORS))} END || CASE WHEN c_acctbal > 0 THEN ' : ' || c_custkey ELSE '' END"


@query("C12_escalatable", f"SELECT c_custkey AS id, coalesce(trim(string_split(e, ':')[1]) IN ({', '.join(repr(x) for x in N.ESCALATE)}) OR trim(e) LIKE 'http\\_%' ESCALATE '\\', false) AS escalates FROM (SELECT c_custkey, {_ERROR} AS e FROM customer)".replace("ESCALATE '\\'", "ESCAPE '\\'"))
def escalatable(t: Tables):
    return rows(t, f"SELECT c_custkey AS id, {_ERROR} AS e FROM {{customer}}").select("id", N.escalatable(F.col("e")).alias("escalates"))


_URLS = "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'ftp://x.org/' || page_id WHEN 2 THEN 'https:///p' ELSE NULL END AS url FROM {pages}"


@query("C14_allowed_urls", f"SELECT id, coalesce(regexp_matches(lower(url), '^https?://[^/?#:]'), false) AS allowed FROM ({plain(_URLS)})")
def allowed_urls(t: Tables):
    return rows(t, _URLS).select("id", H.allowed_url(F.col("url")).alias("allowed"))


@query("A04_id_resolution", "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 0 WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 END AS layer FROM customer")
def id_resolution(t: Tables):
    layer = lambda s: t("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return H.resolved(t("customer").select(F.col("c_custkey").alias("id")), layer("P"), layer("F"))


_ASKED = "SELECT o_custkey AS answer, o_orderkey AS ord, 'u' || (o_orderkey % 3000) AS url FROM {orders}"
_MAPPED = "SELECT o_custkey AS answer, 'u' || (o_orderkey % 3000) AS url FROM {orders} WHERE o_orderstatus = 'P'"
_FETCHED = "SELECT 'u' || l_partkey AS url, l_shipdate AS fetched FROM {lineitem}"
_PLAN = f"""WITH a AS ({plain(_ASKED)}), m AS (SELECT DISTINCT * FROM ({plain(_MAPPED)})), p AS (SELECT url, max(fetched) AS fetched FROM ({plain(_FETCHED)}) GROUP BY url),
    k AS (SELECT a.*, CASE WHEN m.url IS NOT NULL THEN 'skip' WHEN p.fetched >= timestamp '1998-08-01 00:00:00' - INTERVAL 30 DAY THEN 'reuse' END AS known FROM a LEFT JOIN m ON m.answer = a.answer AND m.url = a.url LEFT JOIN p ON p.url = a.url),
    plan AS (SELECT answer, url, coalesce(known, CASE WHEN row_number() OVER (PARTITION BY answer, known IS NULL ORDER BY ord, url) <= 3 THEN 'fetch' ELSE 'left' END) AS action FROM k)"""


def _plan(t: Tables):
    return H.plan(rows(t, _ASKED), rows(t, _MAPPED), rows(t, _FETCHED), F.lit("1998-08-01 00:00:00").cast("timestamp"), 3)


@query("D15_harvest_plan", f"{_PLAN} SELECT * FROM plan")
def harvest_plan(t: Tables):
    return _plan(t)


@query("E19_harvest_outcome", _PLAN + " SELECT answer, " + ", ".join(f"count(*) FILTER (action = '{a}') AS \"{a}\"" for a in ("skip", "reuse", "fetch", "left")) + " FROM plan GROUP BY answer")
def harvest_outcome(t: Tables):
    return H.outcome(_plan(t), "answer")


_LINKED = """SELECT page_id AS id, url, CASE page_id % 3 WHEN 0 THEN '<head><link rel="canonical" href="' || url || '?c=1"></head>' WHEN 1 THEN '<link href="https://elsewhere.invalid/x" rel="canonical">' ELSE '<p>none</p>' END AS html FROM {pages}"""


@query("I10_canonical_url", "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN url || '?c=1' ELSE url END AS canonical FROM pages")
def canonical_url(t: Tables):
    return rows(t, _LINKED).select("id", H.canonical(F.col("html"), F.col("url")).alias("canonical"))


@query("I12_host_suffix", "SELECT page_id AS id, regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*\\.)?example\\.com([/?#:]|$)') AS matches FROM pages")
def host_suffix(t: Tables):
    return t("pages").select(F.col("page_id").alias("id"), T.host_matches(F.col("url"), "example.com").alias("matches"))


_SERIES = """SELECT c_custkey AS id, '<table id="datatable"><tr><th>Date</th><th>Value</th></tr><tr><td>Jan ' || c_custkey || '</td><td>&#x2002; 1,0' || (10 + c_custkey % 80) || '.5%</td></tr> <tr class="odd"><td><b>Feb</b></td> <td>n/a</td></tr></table>' AS html FROM {customer}"""


@query("A21_html_series", "SELECT c_custkey AS id, 'Jan ' || c_custkey AS label, 1000.5 + 10 + c_custkey % 80 AS value FROM customer UNION ALL SELECT c_custkey, 'Feb', NULL FROM customer")
def html_series(t: Tables):
    return rows(t, _SERIES).select("id", F.inline(H.two_columns(F.col("html"))))


_CANDIDATES = "SELECT c_nationkey AS grp, c_name AS symbol, c_custkey % 40 = 0 AS subject, c_custkey % 4 AS sources, c_custkey % 7 AS fund_count FROM {customer}"


@query("G03_candidate_order", f"SELECT grp, symbol, row_number() OVER (PARTITION BY grp ORDER BY subject DESC, sources DESC, fund_count DESC, symbol) AS place FROM ({plain(_CANDIDATES)})")
def candidate_order(t: Tables):
    return H.ordered_candidates(rows(t, _CANDIDATES))


@query("C16_overlap_filter", f"SELECT grp, symbol FROM ({plain(_CANDIDATES)}) WHERE subject OR fund_count >= 2 OR sources >= 3")
def overlap_filter(t: Tables):
    return rows(t, _CANDIDATES).where(F.col("subject") | (F.col("fund_count") >= 2) | (F.col("sources") >= 3)).select("grp", "symbol")


_RANKED = "SELECT o_custkey AS grp, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN ' s' ELSE 'S' END || (o_orderkey % 6) AS symbol, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 7 <> 0 THEN cast(o_orderkey % 10 AS varchar(5)) END AS rank FROM {orders}"


@query("G04_ranked_once", f"""WITH r AS (SELECT grp, ord, upper(trim(symbol)) AS symbol, CASE WHEN regexp_full_match(rank, '[0-9]+') THEN cast(rank AS BIGINT) END AS k FROM ({plain(_RANKED)}) QUALIFY row_number() OVER (PARTITION BY grp, upper(trim(symbol)) ORDER BY ord) = 1)
    SELECT grp, symbol, row_number() OVER (PARTITION BY grp ORDER BY k IS NULL, k, ord) AS place FROM r""")
def ranked_once(t: Tables):
    return H.ranked_once(rows(t, _RANKED))


_LISTS = "SELECT o_custkey AS grp, o_orderdate AS stamp, max(o_orderpriority) AS symbols FROM {orders} GROUP BY o_custkey, o_orderdate"


@query("J07_changed_at", f"WITH v AS (SELECT grp, stamp, CASE WHEN lag(symbols) OVER w IS DISTINCT FROM symbols OR row_number() OVER w = 1 THEN stamp END AS c FROM ({plain(_LISTS)}) WINDOW w AS (PARTITION BY grp ORDER BY stamp)) SELECT grp, max(c) AS changed_at FROM v GROUP BY grp")
def changed_at(t: Tables):
    return H.changed_at(rows(t, _LISTS))


@query("F14_prior_source", "SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM orders")
def prior_source(t: Tables):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("prior"))


@query("H03_skipped_kinds", "SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id % 97 = 0")
def skipped_kinds(t: Tables):
    d = t("documents")
    return d.select("source").subtract(d.where("doc_id % 97 = 0").select("source"))


_OPEN = "SELECT conv_id AS page, turn, role FROM {conversations} WHERE role = 'user'"


@query("E18_open_questions", f"SELECT page, count(*) AS open, sum(count(*)) OVER () AS total FROM ({plain(_OPEN)}) GROUP BY page")
def open_questions(t: Tables):
    per = rows(t, _OPEN).groupBy("page").agg(F.count(F.lit(1)).alias("open"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("open").alias("total"))))


@query("I06_one_line", f"WITH d AS ({plain(DOCS)}) SELECT id, substring(regexp_replace(regexp_replace(coalesce(list_filter(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')[1], ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 60) AS line FROM d")
def one_line(t: Tables):
    return rows(t, DOCS).select("id", T.one_line(F.col("body"), 60).alias("line"))


_CITING = "SELECT doc_id AS id, 'a [^s' || (doc_id % 3) || '] b [^x.1] c [^s' || (doc_id % 2) || '] d' AS body FROM {documents}"


@query("I15_citations", f"SELECT id, CASE WHEN id % 3 = id % 2 THEN 's' || (id % 3) || ',x.1' ELSE 's' || (id % 3) || ',x.1,s' || (id % 2) END AS cited, 'a  b  c  d' AS prose FROM ({plain(_CITING)})")
def citations(t: Tables):
    return rows(t, _CITING).select("id", F.array_join(T.citations(F.col("body")), ",").alias("cited"), T.without_citations(F.col("body")).alias("prose"))


@query("D11_page_sections", "SELECT c_custkey AS page, n_name AS section FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def page_sections(t: Tables):
    owned = t("nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("section"))
    return t("customer").join(owned, "c_nationkey", "left").select(F.col("c_custkey").alias("page"), "section")


@query("D12_gold_sets", "SELECT o_custkey AS question, count(*) AS gold FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_custkey")
def gold_sets(t: Tables):
    current = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(current, "o_orderkey", "left_semi").groupBy(F.col("o_custkey").alias("question")).agg(F.count(F.lit(1)).alias("gold"))
