"""Queries over the texts of pages, filings and reports, and over small values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import pages as X
from tarnbeck.plans.base import Tables, query
from tarnbeck.plans.reports import plain, rows

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _decoded(x: str) -> str:
    for entity, char in X.ENTITIES:
        x = f"replace({x}, '{entity}', '{_q(char)}')"
    return x


def _blocks(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for name in X.DROPPED:
        x = f"regexp_replace({x}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{'|'.join(X.BLOCKS)})\\b[^>]*>', chr(1), 'g')"
    x = f"regexp_replace({x}, '</?[a-zA-Z!?][^>]*>', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(1)), lambda x: trim(regexp_replace({_decoded('x')}, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))"


_TITLES = f"list_filter(list_transform(regexp_extract_all(html, '(?is)<title\\b[^>]*>(.*?)</title', 1), lambda x: trim(regexp_replace({_decoded('x')}, '\\s+', ' ', 'g'))), lambda x: x <> '')[1]"


@query("I09_html_blocks", f"SELECT page_id AS id, {_TITLES} AS title, md5({_blocks('html')}) AS digest, length({_blocks('html')}) AS chars FROM pages")
def html_blocks(t: Tables):
    text = X.html_blocks(F.col("html"))
    return t("pages").select(F.col("page_id").alias("id"), X.html_title(F.col("html")).alias("title"), F.md5(text).alias("digest"), F.length(text).cast("long").alias("chars"))


_FILED = """SELECT doc_id AS id, CASE lang WHEN 'en' THEN '8-K' WHEN 'de' THEN '8-k' ELSE '10-Q' END AS form, 'FORM 8-K' || chr(10) || ' CURRENT REPORT' || chr(10) || 'cover ' || doc_id || chr(10) || 'Item 2 ' || text || chr(10) || chr(10) || chr(10) || 'This report contains forward-looking statements under the Private Securities Litigation Reform Act of 1995. ' || source
    || chr(10) || 'Forward-Looking Statements' || chr(10) || 'a line' || chr(10) || 'You should place no undue reliance on them. Kept.' || chr(10) || 'SIGNATURES' || chr(10) || 'signed by ' || source AS body FROM {documents}"""
_PLAIN = f"regexp_replace(regexp_replace(body, '{X.FORWARD_PARAGRAPH}', '', 'g'), '{X.FORWARD_SECTION}', '', 'g')"
_SHORT = f"regexp_replace(regexp_replace(regexp_replace(plain, '{X.COVER}', '\\1', 'g'), '{X.SIGNATURE}', '', 'g'), '{X.EXHIBITS}', '', 'g')"


@query("I14_boilerplate", f"SELECT id, md5({_STRIP.format(x='kept')}) AS digest FROM (SELECT id, regexp_replace(CASE WHEN upper(form) = '8-K' THEN {_SHORT} ELSE plain END, '\\n{{3,}}', chr(10) || chr(10), 'g') AS kept FROM (SELECT id, form, {_PLAIN} AS plain FROM ({plain(_FILED)})))")
def boilerplate(t: Tables):
    return rows(t, _FILED).select("id", F.md5(X.without_boilerplate(F.col("body"), F.col("form"))).alias("digest"))


_WIKI = "SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN source || ' declares. More' END AS declared, CASE WHEN lang = 'en' THEN 'Scope: this page covers ' || source || '. ' ELSE '' END || '# no' || chr(10) || chr(10) || '**Persona frame: ' || source || '. The firm** [^s1] ' || coalesce(text, '') AS body FROM {documents}"


def _shortened(x: str) -> str:
    s = _STRIP.format(x=f"regexp_extract({x}, '(?s)\\A(.*?(?:[.!?]\\s|\\z))', 1)")
    return f"CASE WHEN length({s}) <= 140 THEN {s} ELSE regexp_replace(regexp_replace(substring({s}, 1, 140), ' [^ ]*\\z', ''), '[,;:]+\\z', '') || '…' END"


_LINES = f"array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: {_STRIP.format(x='x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:[#|>-]|\\d+[.)]\\s)')), ' ')"
_TEXT = f"regexp_replace(regexp_replace(regexp_replace({_LINES}, '{T.CITATION}', ' ', 'g'), '{T.STATUS}', '', 'g'), '\\*\\*|__', '', 'g')"
_TEXT = _STRIP.format(x=f"regexp_replace(regexp_replace({_TEXT}, '\\s+', ' ', 'g'), '\\s+([.,;:)])', '\\1', 'g')")
_TEXT = f"regexp_replace({_TEXT}, '(?i)\\A(?:{X.PREAMBLE}[^.!?:]*(?:[.!?:]+[^\\s.!?:][^.!?:]*)*[.!?:]+(?:\\s+|\\z))+', '')"


@query(
    "I07_summary",
    f"""WITH p AS ({plain(_WIKI)}), b AS (SELECT id, unnest(regexp_split_to_array(body, '\\n\\s*\\n')) AS b, generate_subscripts(regexp_split_to_array(body, '\\n\\s*\\n'), 1) AS i FROM p),
  x AS (SELECT id, i, CASE WHEN regexp_matches(x, '(?i)\\A{X.PREAMBLE}') THEN '' ELSE x END AS x FROM (SELECT id, i, {_TEXT} AS x FROM b)), c AS (SELECT id, i, {_shortened('x')} AS c FROM x),
  k AS (SELECT id, arg_min(c, i) AS c FROM c WHERE length(c) >= 40 AND len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w <> '')) >= 6 AND regexp_matches(c, '^[A-Z("'']') AND NOT ends_with(c, ':') GROUP BY id)
  SELECT p.id, CASE WHEN declared IS NOT NULL THEN {_shortened('declared')} ELSE coalesce(k.c, '') END AS summary FROM p LEFT JOIN k ON k.id = p.id""",
)
def summaries(t: Tables):
    return rows(t, _WIKI).select("id", X.summary(F.col("declared"), F.col("body")).alias("summary"))


_CELLS = "SELECT s_suppkey AS id, '| name | ' || CASE WHEN s_acctbal < 0 THEN '' WHEN s_nationkey < 5 THEN '**+' ELSE '+' END || s_acctbal || '%' || CASE WHEN s_acctbal >= 0 AND s_nationkey < 5 THEN '**' ELSE '' END || ' | -' || s_nationkey || 'x |+1.5pp| plain -3 |' AS body FROM {supplier}"
_CELL = X.SIGNED_CELL.replace(r"\s*(?=\|)", r"\s*\|").replace("'", "''")


@query("I33_marked_cells", f"""SELECT id, '| name | ' || CASE WHEN s_acctbal < 0 THEN '<span class="num neg">' || s_acctbal || '%</span>' WHEN s_nationkey < 5 THEN '**<span class="num pos">+' || s_acctbal || '%</span>**' ELSE '<span class="num pos">+' || s_acctbal || '%</span>' END || ' | <span class="num neg">-' || s_nationkey || 'x</span> | <span class="num pos">+1.5pp</span> | plain -3 |' AS body FROM (SELECT s_suppkey AS id, * FROM supplier)""")
def marked_cells(t: Tables):
    return rows(t, _CELLS).select("id", X.marked_cells(F.col("body")).alias("body"))


_TABLE = "SELECT n_nationkey AS id, '| Facts | Owner |' || chr(10) || '| ' || n_name || ' history, prices, market size | §' || n_regionkey || ' Name |' || chr(10) || 'no row' || chr(10) || '| unit costs | §3 Other |' AS body FROM {nation}"
_SECTIONS = ["first", "second", "third"]


@query("I32_ownership", f"SELECT id, lower(n_name) || ' history' AS phrase, s AS section FROM (SELECT n_nationkey AS id, n_name, ['first', 'second', 'third'][n_regionkey] AS s FROM nation) WHERE s IS NOT NULL UNION ALL SELECT id, 'market size', s FROM (SELECT n_nationkey AS id, ['first', 'second', 'third'][n_regionkey] AS s FROM nation) WHERE s IS NOT NULL UNION ALL SELECT n_nationkey, 'unit costs', 'third' FROM nation")
def ownership(t: Tables):
    return rows(t, _TABLE).select("id", F.inline(X.ownership(F.col("body"), _SECTIONS)))


_LOOSE = "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'nan' WHEN 'MACHINERY' THEN 'n/a' WHEN 'FURNITURE' THEN '-inf' WHEN 'HOUSEHOLD' THEN '' ELSE cast(c_custkey AS varchar(20)) || '.5' END AS value FROM {customer}"


@query("I16_narrowed", f"SELECT id, CASE WHEN isfinite(try_cast(value AS DOUBLE)) THEN try_cast(value AS DOUBLE) END AS value FROM ({plain(_LOOSE)})")
def narrowed(t: Tables):
    return rows(t, _LOOSE).select("id", X.narrowed(F.col("value")).alias("value"))


@query("I29_dates", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dates(t: Tables):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return t("events").select(F.col("event_id").alias("id"), T.date_part(stamp).alias("day"))


_RUNS = "SELECT user_id AS id, min(ts) AS started, CASE WHEN count(*) > 8 THEN max(ts) END AS finished FROM {events} GROUP BY user_id"


@query("I30_elapsed_minutes", f"SELECT id, round(date_diff('microsecond', started, finished) / 60000000.0, 4) AS minutes FROM ({plain(_RUNS)})")
def elapsed(t: Tables):
    return rows(t, _RUNS).select("id", F.round((F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 60_000_000, 4).alias("minutes"))


@query("I38_rgba", "SELECT n_nationkey AS id, CASE WHEN n_regionkey <> 2 THEN 'rgba(' || (n_nationkey * 7 % 256) || ',' || (16 + n_regionkey) || ',255,0.35)' END AS colour FROM nation")
def rgba(t: Tables):
    hexed = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("n_nationkey") * 7 % 256)), 2, "0"), F.lower(F.hex(16 + F.col("n_regionkey"))), F.lit("ff"))
    return t("nation").select(F.col("n_nationkey").alias("id"), X.rgba(F.when(F.col("n_regionkey") != 2, hexed).otherwise("blue"), 0.35).alias("colour"))
