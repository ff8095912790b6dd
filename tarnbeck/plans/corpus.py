"""Queries over the evidence corpus: retrieval, findings, provenance, ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import findings as N
from tarnbeck.operators import ledger as L
from tarnbeck.operators import provenance as P
from tarnbeck.operators import retrieval as R
from tarnbeck.plans.base import CORPUS, NOW, Tables, query

TERMS = ["the", "schlich", "licen[sc]e", "queeau"]
_TERMS = " + ".join(f"cast(regexp_matches(body, '(?i){t}') AS BIGINT)" for t in TERMS)
#: Words that don't search.
STOP = """
a about after against all also an and any are as at be been being between both but by can did do does doing during each
for from had has have how if in into is it its many may might more most much no not of on or other our over should since
so some such than that the their them then there these they this those through to under until up was were what when where
which while who why will with would
""".split()
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query("G01_grep_ranking", f"WITH {CORPUS} SELECT id, kind, as_of, {_TERMS} AS matched FROM corpus WHERE {_TERMS} > 0 ORDER BY matched DESC, as_of DESC, id LIMIT 20")
def grep_ranking(t: Tables):
    return R.search(t.corpus(), TERMS, 20).select("id", "kind", "as_of", "matched")


@query("C07_grep_kind_filter", f"WITH {CORPUS} SELECT id, kind, as_of, {_TERMS} AS matched FROM corpus WHERE kind IN ('src1', 'src2') AND {_TERMS} > 0")
def grep_kinds(t: Tables):
    return R.matched_terms(t.corpus(), TERMS, ["src1", "src2"]).select("id", "kind", "as_of", "matched")


_ANY = "(?i)" + "|".join(f"(?:{x})" for x in TERMS)


@query(
    "I05_context_excerpt",
    f"""WITH {CORPUS}, hits AS (SELECT *, {_TERMS} AS matched FROM corpus WHERE {_TERMS} > 0 ORDER BY matched DESC, as_of DESC, id LIMIT 20),
    ls AS (SELECT id, string_split(body, chr(10)) AS l, list_position(list_transform(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_ANY}')), true) AS line FROM hits)
    SELECT id, cast(line AS BIGINT) AS line, array_to_string(l[greatest(line - 1, 1):least(line + 1, len(l))], chr(10)) AS excerpt FROM ls""",
)
def excerpts(t: Tables):
    return R.search(t.corpus(), TERMS, 20).select("id", "line", "excerpt")


@query(
    "G02_manifest",
    f"""WITH {CORPUS} SELECT id, kind, as_of, cast(strlen(body) AS BIGINT) AS bytes, substring(regexp_replace(regexp_replace(coalesce(list_filter(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')[1], ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 100) AS summary FROM corpus""",
)
def manifest(t: Tables):
    return R.manifest(t.corpus())


@query(
    "I03_query_terms",
    f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '{T.QUERY_TOKEN}'), lambda x: trim(x, '.-/&')), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)))), ' ') AS terms FROM conversations WHERE role = 'user'""",
)
def query_terms(t: Tables):
    rows = t("conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(T.query_terms(F.col("text"), STOP)), " ").alias("terms"))


_RANKED = f"""WITH {CORPUS}, a AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, trim(unnest(regexp_extract_all(lower(text), '{T.QUERY_TOKEN}')), '.-/&') AS term FROM benchmark) WHERE length(term) >= 3 AND NOT list_contains({_STOP}, term)),
  h AS (SELECT DISTINCT id, as_of, unnest(regexp_split_to_array(lower(body), '\\s+')) AS word FROM corpus),
  vocabulary AS (SELECT DISTINCT word FROM h), terms AS (SELECT DISTINCT term FROM a),
  found AS (SELECT term, word FROM terms, vocabulary WHERE CASE WHEN contains(term, '.') THEN regexp_matches(word, term) ELSE contains(word, term) END),
  held AS (SELECT DISTINCT id, as_of, term FROM h JOIN found USING (word)),
  ranked AS (SELECT qid, id, count(*) AS matched, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, as_of DESC, id) AS rank FROM held JOIN a USING (term) GROUP BY qid, id, as_of QUALIFY rank <= 10)"""


def _matches(t: Tables):
    questions = t("benchmark").select(F.col("item_id").alias("qid"), T.query_terms(F.col("text"), STOP).alias("terms"))
    return R.matches_per_question(t.corpus(), questions)


def _ranked(t: Tables):
    return R.best_matches(_matches(t), 10)


@query("E09_ranked_per_question", f"{_RANKED} SELECT qid, id, matched, rank FROM ranked")
def ranked(t: Tables):
    return _ranked(t).select("qid", "id", "matched", "rank")


_GOLD = "g AS (SELECT DISTINCT b.item_id AS qid, c.id FROM benchmark b JOIN corpus c ON contains(c.body, b.text))"


def _recall(t: Tables):
    """Recall of the ten best over the documents that hold the whole of an item.

    Those are looked for among the documents with all terms of it; for items without terms by an equi-join on three
    words of it, then the exact test on the few that meet.
    """
    matches, items = _matches(t), t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    bare = items.where(F.size(T.query_terms(F.col("item"), STOP)) == 0).select("qid", F.array_join(F.slice(T.words(F.col("item")), 2, 3), " ").alias("k"))
    gold, n_bare = R.holders(matches, t.corpus(), items), bare.count()
    if n_bare:
        docs = t.corpus().select("id", T.words(F.col("body")).alias("w")).where(F.size("w") >= 3)
        grams = docs.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("k"))
        met = grams.join(F.broadcast(bare) if n_bare <= 100_000 else bare, "k").select("qid", "id").distinct()
        gold = gold.union(met.join(t.corpus().select("id", "body"), "id").join(items, "qid").where(F.contains("body", "item")).select("qid", "id").distinct())
    return R.recall(R.best_matches(matches, 10), gold)


@query("D13_recall_at_k", f"{_RANKED}, {_GOLD} SELECT g.qid, count(*) AS n_gold, round(sum(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END) / count(*), 4) AS recall FROM g LEFT JOIN ranked r ON r.qid = g.qid AND r.id = g.id GROUP BY g.qid")
def recall(t: Tables):
    return _recall(t)


@query("E06_mean_recall", f"{_RANKED}, {_GOLD}, r AS (SELECT g.qid, sum(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END) / count(*) AS recall FROM g LEFT JOIN ranked r ON r.qid = g.qid AND r.id = g.id GROUP BY g.qid) SELECT round(avg(round(recall, 4)), 3) AS mean_recall, count(*) AS scored, (SELECT count(*) FROM benchmark) - count(*) AS skipped FROM r")
def mean_recall(t: Tables):
    scored = _recall(t).agg(F.round(F.avg("recall"), 3).alias("mean_recall"), F.count(F.lit(1)).alias("scored"))
    return scored.crossJoin(t("benchmark").agg(F.count(F.lit(1)).alias("n"))).select("mean_recall", "scored", (F.col("n") - F.col("scored")).alias("skipped"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


# RE2 knows the same patterns but for the look-behind, which is a group there as well.
_SECRET = " UNION ALL ".join(f"SELECT id, '{n}' AS problem FROM corpus WHERE regexp_matches(body, '{_quoted(p)}')" for n, p in N.SECRETS.items())


@query("C06_secret_scan", f"WITH {CORPUS} {_SECRET}")
def secrets(t: Tables):
    return N.secret_findings(t.corpus())


_PARS = f"WITH {CORPUS}, pars AS (SELECT id, unnest(regexp_split_to_array(body, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(body, '\\n\\s*\\n'), 1) - 1 AS par FROM (SELECT id, replace(body, chr(10), chr(10) || chr(10)) AS body FROM corpus))"


def _pages(t: Tables):
    """Each line of a document as a paragraph."""
    return t.corpus().withColumn("body", F.replace("body", F.lit("\n"), F.lit("\n\n")))


@query("C24_uncited_numbers", f"{_PARS} SELECT id, par FROM pars WHERE regexp_matches(regexp_replace(p, '{T.CITATION}', '', 'g'), '{T.NUMBER}') AND NOT regexp_matches(p, '{T.CITATION}')")
def uncited(t: Tables):
    return N.uncited_numbers(_pages(t))


@query("C25_untagged_forward_numbers", f"{_PARS} SELECT id, par FROM pars WHERE regexp_matches(p, '{T.FORWARD}') AND regexp_matches(p, '{T.NUMBER}') AND NOT regexp_matches(p, '{T.STATUS}')")
def forward(t: Tables):
    return N.untagged_forward_numbers(_pages(t))


@query("C10_block_page_verdict", f"WITH {CORPUS} SELECT id, CASE WHEN strlen(body) >= 0 AND length(body) <= 300 AND regexp_matches(lower(body), '{'|'.join(N.BLOCK_WORDS)}') THEN 'block_page' WHEN length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) < 400 THEN 'thin' ELSE 'ok' END AS verdict FROM corpus")
def verdicts(t: Tables):
    return t.corpus().select("id", N.page_verdict(F.lit(None).cast("string"), F.col("body")).alias("verdict"))


@query("C22_internal_names", f"WITH {CORPUS} SELECT id, len(list_distinct(list_concat({', '.join(f'''regexp_extract_all(body, '{p}')''' for p in N.INTERNAL)}))) AS n FROM corpus")
def internal(t: Tables):
    return t.corpus().select("id", F.size(N.internal_names(F.col("body"))).cast("long").alias("n"))


_RULES = [(1, "contains", "the"), (2, "regex", "[A-Z]{3,}"), (3, "not_regex", "!!"), (4, "min_length", "400"), (5, "max_length", "5000"), (6, "wishful", "x"), (7, "startswith", "The")]


@query(
    "C18_text_rules",
    f"""WITH {CORPUS}, rules(rule_id, rule, value) AS (VALUES {', '.join(f"({a}::BIGINT, '{b}', '{c}')" for a, b, c in _RULES)})
    SELECT id, rule_id, CASE rule WHEN 'contains' THEN contains(body, value) WHEN 'regex' THEN regexp_matches(body, '[A-Z]{{3,}}') WHEN 'not_regex' THEN NOT regexp_matches(body, '!!') WHEN 'min_length' THEN length(body) >= try_cast(value AS BIGINT) WHEN 'max_length' THEN length(body) <= try_cast(value AS BIGINT)
      WHEN 'startswith' THEN starts_with(coalesce(list_filter(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')[1], ''), value) ELSE false END AS passed FROM corpus, rules""",
)
def text_rules(t: Tables):
    return N.text_rules(t.corpus(), t.spark.createDataFrame(_RULES, "rule_id long, rule string, value string"))


@query("E17_word_counts", f"WITH {CORPUS} SELECT kind, cast(sum(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, count(*) AS docs FROM corpus GROUP BY kind")
def word_counts(t: Tables):
    return t.corpus().groupBy("kind").agg(F.sum(T.word_count(F.col("body"))).alias("words"), F.count(F.lit(1)).alias("docs"))


@query("I01_slug", f"WITH {CORPUS} SELECT id, substring(trim(regexp_replace(regexp_replace(lower(body), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-'), 1, 60) AS slug FROM corpus")
def slugs(t: Tables):
    return t.corpus().select("id", T.slug(F.col("body")).alias("slug"))


@query("I11_site_name", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#:]+)', 1)), '^www\\.', '') AS site FROM pages")
def sites(t: Tables):
    return t("pages").select("page_id", T.site_name(F.col("url")).alias("site"))


@query("I13_html_artifact_cleanup", "SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#?[a-zA-Z0-9]+;', '', 'g'), ' {3,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM pages)")
def cleaned(t: Tables):
    text = T.artifact_free(F.col("html"))
    return t("pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


_REFS = "refs AS (SELECT doc_id AS carrier, (doc_id * 7919) % (SELECT 2 * count(*) FROM documents) AS ref FROM documents UNION SELECT doc_id, (doc_id * 31 + 5) % 1500 FROM documents)"


def _refs(t: Tables):
    d = t("documents").select("doc_id")
    n = d.agg((2 * F.count(F.lit(1))).alias("n"))
    return d.crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("carrier"), ((F.col("doc_id") * 7919) % F.col("n")).alias("ref")).union(d.select("doc_id", (F.col("doc_id") * 31 + 5) % 1500))


@query("D04_derivation_resolution", f"WITH {_REFS} SELECT carrier, ref FROM refs WHERE ref NOT IN (SELECT doc_id FROM documents)")
def unresolved(t: Tables):
    return P.unresolved(_refs(t), t("documents").select(F.col("doc_id").alias("artifact")))


@query("D01_citation_resolution", f"WITH {_REFS} SELECT carrier, ref AS cid, CASE WHEN d.doc_id IS NOT NULL THEN 'bronze' WHEN l.doc_id IS NOT NULL THEN 'silver' ELSE 'missing' END AS layer FROM refs LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = ref LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = ref")
def citation_layers(t: Tables):
    own = t("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("artifact"), F.lit("bronze").alias("layer"))
    shared = t("labels").select(F.col("doc_id").alias("artifact")).distinct().withColumn("layer", F.lit("silver"))
    return P.resolve(_refs(t).distinct().select("carrier", F.col("ref").alias("cid")), own, shared)


@query("D18_lineage_expansion", "WITH RECURSIVE e AS (SELECT c_custkey AS node, (c_custkey * 17 + 3) % 700 AS source FROM customer UNION SELECT c_custkey, c_custkey // 2 FROM customer), w AS (SELECT node AS root, source AS node, 1 AS depth FROM e WHERE node <> source UNION SELECT w.root, e.source, w.depth + 1 FROM w JOIN e ON e.node = w.node WHERE w.depth < 3 AND e.source <> w.root) SELECT root, node, cast(min(depth) AS BIGINT) AS depth FROM w GROUP BY root, node")
def lineage(t: Tables):
    c = t("customer")
    edges = c.select(F.col("c_custkey").alias("node"), ((F.col("c_custkey") * 17 + 3) % 700).alias("source")).union(c.select("c_custkey", F.expr("c_custkey div 2"))).distinct()
    return P.lineage(edges)


@query("J01_policy_staleness", f"""SELECT user_id, CASE WHEN user_id % 5 = 0 THEN epoch(timestamp '{NOW}') - epoch(date_trunc('second', f)) > 86400 * 3 WHEN user_id % 5 = 1 THEN cast(f AS DATE) < date '2024-01-30' ELSE epoch(timestamp '{NOW}') - epoch(date_trunc('second', f)) > 86400 * 7 END AS stale FROM (SELECT user_id, max(ts) AS f FROM events GROUP BY user_id)""")
def staleness(t: Tables):
    last = t("events").groupBy("user_id").agg(F.max("ts").alias("f"))
    limit = F.when(F.col("user_id") % 5 == 0, F.lit(3))
    due = P.stale(F.lit(NOW).cast("timestamp"), limit, F.col("f"), F.col("user_id") % 5 == 1, F.lit("2024-01-30").cast("date"), F.lit(False))
    return last.select("user_id", due.alias("stale"))


@query("D09_newer_stamp_invalidation", "WITH a AS (SELECT o_custkey AS qid, o_orderkey AS ord, o_orderkey % 500 AS id, o_orderdate AS stamp FROM orders), s AS (SELECT o_orderkey % 500 AS id, max(o_orderdate) AS now FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT qid, arg_min(a.id, ord) AS evidence FROM a JOIN s USING (id) WHERE s.now > a.stamp OR a.id % 97 = 0 GROUP BY qid")
def invalidation(t: Tables):
    o = t("orders")
    answers = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 500).alias("id"), F.col("o_orderdate").alias("stamp"))
    stamps = o.where("o_orderstatus = 'F'").groupBy((F.col("o_orderkey") % 500).alias("id")).agg(F.max("o_orderdate").alias("stamp"))
    return P.invalidated(answers, stamps, stamps.where("id % 97 = 0").select("id"))


@query("D10_subscription_arrival", "SELECT q.conv_id AS qid, arg_min(e.event_id, e.event_id) AS evidence FROM (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY conv_id) q JOIN (VALUES (0, 'click'), (1, 'purchase'), (1, 'view'), (2, 'signup')) s(section, kind) ON q.conv_id % 3 = s.section JOIN events e ON e.event_type = s.kind AND e.ts > timestamp '2024-01-10' + to_days(cast(q.conv_id % 15 AS INTEGER)) GROUP BY q.conv_id")
def arrivals(t: Tables):
    days = F.expr("timestamp'2024-01-10' + make_dt_interval(cast(conv_id % 15 as int))")
    asked = t("conversations").select("conv_id").distinct().select(F.col("conv_id").alias("qid"), (F.col("conv_id") % 3).cast("int").alias("section"), days.alias("answered_at"))
    subs = t.spark.createDataFrame([(0, "click"), (1, "purchase"), (1, "view"), (2, "signup")], "section int, kind string")
    events = t("events").select(F.col("event_type").alias("kind"), F.col("ts").alias("stamp"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"))
    return P.first_arrival(asked, events, subs)


@query("J03_supersede_current", "WITH s AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders) SELECT id FROM s WHERE id NOT IN (SELECT supersedes FROM s WHERE supersedes IS NOT NULL)")
def supersede(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return P.current(t("orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("supersedes"))).select("id")


@query("B05_id_allocation", "SELECT o_custkey AS stem, o_orderkey AS ord, o_custkey || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def ids(t: Tables):
    out = P.ids_with_suffix(t("orders").select(F.col("o_custkey").cast("string").alias("stem"), F.col("o_orderkey").alias("ord")))
    return out.select(F.col("stem").cast("long").alias("stem"), "ord", "id")


_BATCHES = "SELECT c_nationkey AS section, c_custkey AS ord, CASE WHEN n > 4 AND n % 4 = 1 AND rn = n - 1 THEN cast(ceil(rn / 4) AS BIGINT) + 1 ELSE cast(ceil(rn / 4) AS BIGINT) END AS batch FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"


def _batches(t: Tables):
    return L.batched(t("customer").select(F.col("c_nationkey").alias("section"), F.col("c_custkey").alias("ord")))


@query("F16_batches", _BATCHES)
def batches(t: Tables):
    return _batches(t)


@query("F17_waves", f"SELECT section, batch, cast(floor((row_number() OVER (ORDER BY section, batch) - 1) / 16) AS BIGINT) AS wave FROM (SELECT DISTINCT section, batch FROM ({_BATCHES}))")
def waves(t: Tables):
    return L.waves(_batches(t))


@query("D24_one_for_one_join", "WITH a AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS left_value FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS right_value FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n) AS n, left_value, right_value FROM a FULL JOIN b ON a.k = b.k AND a.n = b.n")
def one_for_one(t: Tables):
    side = lambda s: t("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("value"))
    return L.one_for_one(side("F"), side("O"), ["k"])


@query("J04_question_state", "SELECT conv_id, count(*) AS attempts, CASE WHEN conv_id % 4 <> 0 AND count(*) >= 3 THEN 'deferred' WHEN conv_id % 4 <> 0 THEN 'open' ELSE 'answered' END AS status FROM conversations GROUP BY conv_id")
def question_state(t: Tables):
    n = t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("attempts"))
    return n.select("conv_id", "attempts", L.next_status(F.when(F.col("conv_id") % 4 == 0, "answered").otherwise("open"), F.col("attempts")).alias("status"))


@query("E04_run_totals", "SELECT event_type AS purpose, count(*) AS agents, round(sum(coalesce(value, 0)), 2) AS tokens FROM events GROUP BY event_type")
def run_totals(t: Tables):
    return t("events").groupBy(F.col("event_type").alias("purpose")).agg(F.count(F.lit(1)).alias("agents"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("tokens"))


@query("H02_due_kinds", "SELECT DISTINCT source FROM documents WHERE doc_id % 7 = 0 UNION SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 3 = 0)")
def due(t: Tables):
    d = t("documents").select("source", "doc_id")
    never = d.join(d.where("doc_id % 3 = 0").select("source").distinct(), "source", "left_anti")
    return d.where("doc_id % 7 = 0").select("source").union(never.select("source")).distinct()


@query("D25_duplicate_lines_across_pages", f"WITH {CORPUS}, l AS (SELECT DISTINCT id, unnest(string_split(body, chr(10))) AS line FROM corpus) SELECT md5(line) AS figure, count(*) AS pages FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1")
def shared_lines(t: Tables):
    lines = t.corpus().select("id", F.explode(F.array_distinct(F.split("body", "\n"))).alias("line")).where("line <> ''")
    return lines.groupBy(F.md5("line").alias("figure")).agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")


@query("D14_url_latest_source", "SELECT regexp_replace(url, '[?#].*$', '') AS url, max(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1")
def by_url(t: Tables):
    return t("pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("url")).agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies"))
