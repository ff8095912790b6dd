"""Evidence files written from documents and read back: sources, structured artifacts, data blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.shared import fresh_folder
from tarnbeck.plans.base import Tables, query
from tarnbeck.sources.evidence import front_matter, read_evidence, write_evidence


_LINKS = r"https?://[A-Za-z0-9./_-]+"


def _docs(t: Tables) -> DataFrame:
    file = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return t("documents").select("doc_id", "text", "lang", F.coalesce("source", F.lit("none")).alias("folder"), file.alias("id"), F.coalesce("n_chars", F.lit(0)).alias("n"))


def _sources(t: Tables) -> str:
    """Short documents lack a title, long ones are flagged as truncated; links in the text are cited."""
    at, links = fresh_folder(t.spark, "sources"), F.array_distinct(F.regexp_extract_all("text", F.lit(_LINKS), F.lit(0)))
    keys = {
        "id": F.col("id"), "ticker": F.upper("folder"), "kind": F.coalesce("lang", F.lit("other")), "source": F.col("folder"), "url": F.concat(F.lit("https://x.org/?a=b: c#"), F.col("id")),
        "fetched_at": F.lit("2024-01-05T00:00:00Z"), "as_of": F.date_add(F.lit("2024-01-01").cast("date"), F.length("text") % 365).cast("string"),
        "title": F.when(F.col("n") >= 300, F.get(F.split("text", "\n"), F.lit(0))), "fetch_tool": F.lit("crawl"), "fetch_cmd": F.lit("crawl 'all' # \"of\" it"),
        "request": F.when(F.col("n") % 2 == 0, F.struct(F.col("lang"), F.col("n"))), "cited_urls": F.when(F.size(links) > 0, links), "truncated": F.when(F.col("n") > 10000, F.lit(True)),
    }
    write_evidence(_docs(t).select("folder", F.lit("sources").alias("below"), F.concat("id", F.lit(".md")).alias("name"), front_matter(keys, F.col("text")).alias("content")), at)
    return at


_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, text AS raw, lang, coalesce(source, 'none') AS folder, 'doc-' || doc_id AS id, coalesce(n_chars, 0) AS n FROM documents)"
_READ = f"{_D}, s AS (SELECT folder, id AS file, n >= 300 AND raw IS NOT NULL AS ok, coalesce(lang, 'other') AS kind, cast(date '2024-01-01' + cast(length(text) % 365 AS INTEGER) AS VARCHAR) AS as_of, string_split(text, chr(10))[1] AS title, CASE WHEN n % 2 = 0 THEN '{{' || CASE WHEN lang IS NULL THEN '' ELSE '\"lang\":\"' || lang || '\",' END || '\"n\":' || n || '}}' END AS request, list_distinct(regexp_extract_all(text, '{_LINKS}')) AS links, n > 10000 AS truncated, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM d)"


@query(
    "A01_source_scan",
    f"WITH {_READ} SELECT folder, file, CASE WHEN ok THEN upper(folder) END AS ticker, CASE WHEN ok THEN kind END AS kind, CASE WHEN ok THEN 'https://x.org/?a=b: c#' || file END AS url, CASE WHEN ok THEN as_of END AS as_of, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN 'crawl ''all'' # \"of\" it' END AS fetch_cmd, CASE WHEN ok THEN request END AS request, ok AND truncated AS truncated, CASE WHEN ok THEN array_to_string(list_sort(links), ' ') ELSE '' END AS cited, CASE WHEN ok THEN md5(body) END AS body, CASE WHEN NOT ok THEN 'missing required key ''title''' END AS problem FROM s",
)
def source_scan(t: Tables):
    rows = read_evidence(t.spark, _sources(t), mode="permissive")
    return rows.select("folder", "file", "ticker", "kind", "url", "as_of", "title", "fetch_cmd", "request", "truncated", F.array_join(F.array_sort("cited_urls"), " ").alias("cited"), F.md5("body").alias("body"), "problem")


@query("A01_sources_of_a_kind", f"WITH {_READ} SELECT folder, file AS id, as_of, title FROM s WHERE ok AND kind = 'de'")
def sources_of_a_kind(t: Tables):
    """Only front matters are read, and the kind is tested in the source."""
    rows = read_evidence(t.spark, _sources(t), columns=["folder", "id", "kind", "as_of", "title", "problem"], mode="permissive")
    return rows.where("kind = 'de'").select("folder", "id", "as_of", "title")


def _artifacts(t: Tables, broken: bool) -> str:
    """Documents as artifacts; short ones lack their producer, and where asked for, those in French are cut in the middle."""
    at = fresh_folder(t.spark, "structured")
    meta = F.struct("id", F.upper("folder").alias("ticker"), F.when(F.col("n") >= 300, F.lit("fetch")).alias("producer"), F.lit("Text").alias("title"), F.col("folder").alias("source"), F.lit("2024-01-05").alias("as_of"), F.struct("lang").alias("request"), (F.col("n") > 10000).alias("adjusted"), F.array("folder", "id").alias("derived_from"))
    whole = F.to_json(F.struct(meta.alias("_meta"), F.struct(F.coalesce("text", F.lit("")).alias("text"), "n").alias("data")))
    content = F.when(F.col("lang") == "fr", F.substr(whole, F.lit(1), F.length(whole) - 5)).otherwise(whole) if broken else whole
    write_evidence(_docs(t).where("n >= 300" if broken else "true").select("folder", F.lit("structured").alias("below"), F.concat("id", F.lit(".json")).alias("name"), content.alias("content")), at)
    return at


@query(
    "A02_structured_scan",
    f"WITH {_D} SELECT folder, id AS file, CASE WHEN n >= 300 THEN upper(folder) END AS ticker, CASE WHEN n >= 300 THEN 'fetch' END AS producer, CASE WHEN n >= 300 THEN CASE WHEN lang IS NULL THEN '{{}}' ELSE '{{\"lang\":\"' || lang || '\"}}' END END AS request, CASE WHEN n >= 300 THEN n > 10000 END AS adjusted, CASE WHEN n >= 300 THEN folder || ' ' || id ELSE '' END AS derived_from, CASE WHEN n >= 300 THEN md5(text) END AS text, CASE WHEN n >= 300 THEN n END AS n, CASE WHEN n < 300 THEN 'missing required key ''producer''' END AS problem FROM d",
)
def structured_scan(t: Tables):
    rows = read_evidence(t.spark, _artifacts(t, False), "structured", mode="permissive").withColumn("d", F.from_json("data", "text string, n bigint"))
    return rows.select("folder", "file", "ticker", "producer", "request", "adjusted", F.array_join("derived_from", " ").alias("derived_from"), F.md5("d.text").alias("text"), "d.n", "problem")


@query("A03_artifact_data", f"WITH {_D} SELECT doc_id, CASE WHEN ok THEN md5(text) END AS text, CASE WHEN ok THEN n END AS n FROM (SELECT *, n >= 300 AND lang IS DISTINCT FROM 'fr' AS ok FROM d)")
def artifact_data(t: Tables):
    """The data block of every document's artifact; null where the file is missing or can't be read."""
    rows = read_evidence(t.spark, _artifacts(t, True), "artifacts", columns=["folder", "file", "data"]).withColumn("d", F.from_json("data", "text string, n bigint"))
    asked = _docs(t).select("doc_id", "folder", F.col("id").alias("file"))
    return asked.join(rows, ["folder", "file"], "left").select("doc_id", F.md5("d.text").alias("text"), "d.n")
