"""Fetched pages and artifacts: shapes, resolution, plans and counts of harvests, tables and links in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T

def material(items: Column, listed: list[str]) -> Column:
    """Whether a filing reports a listed item; one that names no items is kept."""
    return F.coalesce(F.size(items) <= 0, F.lit(True)) | F.arrays_overlap(F.coalesce(items, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in listed]))


def allowed_url(url: Column) -> Column:
    """http or https, with a host."""
    return F.coalesce(F.lower(url).rlike("^https?://") & (T.host(url) != ""), F.lit(False))


def resolved(wanted: DataFrame, *layers: DataFrame) -> DataFrame:
    """id of wanted with layer (from 0, null if nowhere): the first of the layers (id) that has it."""
    found = None
    for i, layer in enumerate(layers):
        rows = layer.select("id", F.lit(i).alias("layer"))
        found = rows if found is None else found.union(rows)
    return wanted.join(found.groupBy("id").agg(F.min("layer").alias("layer")), "id", "left")


def plan(urls: DataFrame, mapped: DataFrame, pages: DataFrame, now: Column, most: int, days: int = 30) -> DataFrame:
    """url, action of an answer's urls (answer, ord, url): skip those mapped, reuse fresh pages (url, fetched), fetch up to `most` an answer and leave the others."""
    newest = pages.groupBy("url").agg(F.max("fetched").alias("fetched"))
    rows = urls.join(mapped.select("answer", "url", F.lit(True).alias("_m")).distinct(), ["answer", "url"], "left").join(newest, "url", "left")
    known = F.when(F.col("_m"), "skip").when(F.col("fetched") >= now - F.make_dt_interval(F.lit(days)), "reuse")
    rank = F.row_number().over(Window.partitionBy("answer", F.col("_known").isNull()).orderBy("ord", "url"))
    return rows.withColumn("_known", known).select("answer", "url", F.coalesce("_known", F.when(rank <= most, "fetch").otherwise("left")).alias("action"))


def outcome(rows: DataFrame, key: str) -> DataFrame:
    """Counts of each action."""
    count = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(a)
    return rows.groupBy(key).agg(*[count(a) for a in ("skip", "reuse", "fetch", "left")])


def canonical(html: Column, fallback: Column) -> Column:
    """A page's canonical link if it is of the same site, else the address that it was fetched from."""
    tag = F.regexp_extract(html, r"""(?i)(<link\b[^>]*\brel=["']?canonical["']?[^>]*>)""", 1)
    link = F.regexp_extract(tag, r"""(?i)\bhref=["']([^"'>\s]+)["']""", 1)
    return F.when((link != "") & (T.site_name(link) == T.site_name(fallback)), link).otherwise(fallback)


def two_columns(html: Column) -> Column:
    """Pairs of cells of the rows of two cells in a table, tags dropped."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>.*?</td>\s*</tr>"), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>.*?</td>\s*<td[^>]*>(.*?)</td>\s*</tr>"), F.lit(1))
    bare = lambda x: F.trim(F.regexp_replace(x, "<[^>]*>|&[a-z#0-9]+;", ""))
    return F.zip_with(rows, values, lambda a, b: F.struct(bare(a).alias("label"), F.regexp_replace(bare(b), "[,%$]", "").try_cast("double").alias("value")))


def ordered_candidates(rows: DataFrame) -> DataFrame:
    """place of candidates (grp, symbol, subject, sources, fund_count): the subject, then more sources, more funds, name."""
    w = Window.partitionBy("grp").orderBy(F.desc("subject"), F.desc("sources"), F.desc("fund_count"), "symbol")
    return rows.select("grp", "symbol", F.row_number().over(w).cast("long").alias("place"))


def ranked_once(rows: DataFrame) -> DataFrame:
    """place of ranked names (grp, ord, symbol, rank as text): the first of repeated names stays, whole ranks go up, all else last as it came."""
    first = F.row_number().over(Window.partitionBy("grp", F.upper(F.trim("symbol"))).orderBy("ord"))
    rank = F.when(F.col("rank").rlike("^[0-9]+$"), F.col("rank").try_cast("long"))
    kept = rows.withColumn("_n", first).where("_n = 1").withColumn("_k", rank)
    w = Window.partitionBy("grp").orderBy(F.col("_k").isNull(), "_k", "ord")
    return kept.select("grp", F.upper(F.trim("symbol")).alias("symbol"), F.row_number().over(w).cast("long").alias("place"))


def changed_at(versions: DataFrame) -> DataFrame:
    """Per group (grp, stamp, symbols) the stamp from which on the newest list of symbols has stood without a change."""
    w = Window.partitionBy("grp").orderBy("stamp")
    before = F.lag("symbols").over(w)
    return versions.withColumn("_c", F.when(~before.eqNullSafe(F.col("symbols")) | (F.row_number().over(w) == 1), F.col("stamp"))).groupBy("grp").agg(F.max("_c").alias("changed_at"))
