"""Report texts: tables, exhibits, sentences, excerpts; and the joins that assemble a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T

# Patterns of the checks.
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)"
MARKER = r"(\[\^[^\]\s]+\])"
NUMERIC_CELL = r"^[+-]?\$?[0-9][0-9,.]*(%|x|bp)?$"


def longest_sentence(docs: DataFrame) -> DataFrame:
    """id, place (from 0), words of each text's longest sentence, the first of equals; tables, headings and quotes don't count."""
    prose = F.array_join(F.filter(F.split("body", "\n"), lambda x: ~F.ltrim(x).rlike("^[|#>]")), "\n")
    rows = docs.select("id", F.posexplode(F.split(prose, r"(?<=[.!?])\s+")).alias("place", "sentence"))
    best = F.max(F.struct(T.word_count(F.col("sentence")).alias("words"), (-F.col("place")).alias("back"))).alias("m")
    return rows.groupBy("id").agg(best).select("id", (-F.col("m.back")).cast("long").alias("place"), F.col("m.words").alias("words"))


def repeated_exhibits(docs: DataFrame) -> DataFrame:
    """Images that one report shows more than once."""
    shown = docs.select("id", F.explode(F.regexp_extract_all("body", F.lit(IMAGE), F.lit(1))).alias("image"))
    return shown.groupBy("id", "image").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(text: Column, most: int = 5) -> Column:
    """The first different citation markers that are left in a finished text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))), 1, most)


def cell(text: Column) -> Column:
    """As a Markdown table's cell."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def numeric_columns(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """id, col (from 0), numeric: whether that share of a table column's cells with something in them are numbers.

    The text's table rows are taken as one table; the first is its head, and rows of dashes don't count.
    """
    lines = docs.select("id", F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x).rlike(r"^\|.*\|$") & ~x.rlike(r"^[|\s:-]+$"))).alias("row", "line"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = lines.where("row > 0").select("id", F.posexplode(F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))).alias("col", "cell"))
    used = cells.where("cell <> '' and cell <> '-' and lower(cell) <> 'n/a'")
    return used.groupBy("id", F.col("col").cast("long").alias("col")).agg((F.avg(F.col("cell").rlike(NUMERIC_CELL).cast("int")) >= share).alias("numeric"))


def merged_spans(hits: DataFrame, window: int) -> DataFrame:
    """Spans of `window` characters about hits (id, pos, size of the text), those that overlap or touch as one."""
    spans = hits.select("id", F.greatest(F.col("pos") - window, F.lit(0)).alias("start"), F.least(F.col("pos") + window, F.col("size")).alias("end"))
    w = Window.partitionBy("id").orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= F.col("_reached"), 0).otherwise(1)
    island = spans.withColumn("_reached", reached).withColumn("_island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def unindexed(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Names of pages that the index (one row, text) doesn't mention."""
    text = index.first()  # one text, which a person reads
    return pages.where(~F.contains(F.lit(text["text"] if text else ""), "name")).select("name")


def owned_elsewhere(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Phrases (phrase, section; one lower-case word each) that a text of another section uses."""
    used = docs.select("id", "section", F.explode(F.array_distinct(F.split(F.lower("body"), "[^a-z0-9]+"))).alias("phrase"))
    return used.join(owners.withColumnRenamed("section", "owner"), "phrase").where("section <> owner").select("id", "phrase", "owner")


def origins(carriers: DataFrame, sources: DataFrame) -> DataFrame:
    """For each carrier (id, urls) the first source of every url that has one, in the order of the urls."""
    first = sources.groupBy("url").agg(F.min("source").alias("source"))
    rows = carriers.select("id", F.posexplode("urls").alias("at", "url")).join(first, "url")
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("s")).select("id", F.transform("s", lambda x: x["source"]).alias("sources"))


def chart_choice(chosen: DataFrame, rendered: DataFrame, sections: list[str], dashboard: list[str]) -> DataFrame:
    """number of the charts (ord, name, section) that stand, counted within their section; the reason for those that don't."""
    rows = chosen.join(rendered.select("name", F.lit(True).alias("_there")).distinct(), "name", "left")
    reason = F.when(F.col("_there").isNull(), "no image").when(~F.col("section").isin(*sections), "unknown section").when(F.col("name").isin(*dashboard), "dashboard chart")
    w = Window.partitionBy("section", F.col("reason").isNull()).orderBy("ord", "name")
    return rows.withColumn("reason", reason).select("ord", "name", "section", "reason", F.when(F.col("reason").isNull(), F.row_number().over(w)).cast("long").alias("number"))


def next_date(rows: DataFrame, day: str, today: str) -> DataFrame:
    """Per symbol the earliest date from today on, and the latest before or on it."""
    d, t = F.col(day), F.lit(today).cast("date")
    return rows.groupBy("symbol").agg(F.min(F.when(d >= t, d)).alias("next"), F.max(F.when(d <= t, d)).alias("last"))
