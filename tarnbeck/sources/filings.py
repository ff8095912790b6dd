"""Recorded filings, calls, encyclopedia pages, topic answers, ledgers, task logs and verdicts as tables.

As in payloads: one JSON text a ticker (columns ticker, payload); what isn't JSON or has another shape counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.sources.payloads import part

# Names of the two periodic forms, days of current reports, characters of a summary, the report's sections.
FORMS = {"tenk": "sec_10k", "tenq": "sec_10q"}
LOOKBACK_DAYS = 365
LEAST_SUMMARY = 100
SECTIONS = ["profile", "business_model", "competitive", "supply_chain", "financial", "valuation", "risk_news"]
SEEDS = (4, 6)


def filed(rows: DataFrame) -> DataFrame:
    """ticker, form, id, period_end of the periodic filings in an answer; one without its date is missing."""
    shape = "STRUCT<filing_date: STRING, period_end: STRING>"
    each = F.array(*[F.struct(F.lit(slug).alias("form"), part(f"$.{key}", shape).alias("f")) for key, slug in FORMS.items()])
    dated = rows.select("ticker", F.inline(each)).where(F.coalesce("f.filing_date", F.lit("")) != "")
    return dated.select("ticker", "form", F.concat_ws("_", "f.filing_date", "form").alias("id"), F.col("f.period_end").alias("period_end"))


def current_reports(rows: DataFrame, today: str, days: int = LOOKBACK_DAYS) -> DataFrame:
    """ticker, n, filing_date, accession of the reports of the last `days`, newest first, equal dates in the answer's order."""
    shape = "ARRAY<STRUCT<filing_date: STRING, accession: STRING>>"
    each = rows.select("ticker", F.posexplode(part("$.eightks", shape)).alias("place", "f"))
    first = F.date_sub(F.lit(today).cast("date"), days).cast("string")
    recent = each.where(F.col("f.filing_date") >= first)
    newest = Window.partitionBy("ticker").orderBy(F.desc("f.filing_date"), "place")
    accession = F.coalesce("f.accession", F.lit("unknown"))
    return recent.select("ticker", F.row_number().over(newest).alias("n"), F.col("f.filing_date").alias("filing_date"), accession.alias("accession"))


def latest_call(rows: DataFrame) -> DataFrame:
    """ticker, date, year, quarter of the newest dated call, the first of equal dates; none if its period isn't numbers."""
    shape = "ARRAY<STRUCT<date: STRING, fiscalYear: STRING, quarter: STRING>>"
    each = rows.select("ticker", F.posexplode(part("$", shape)).alias("place", "c")).where(F.coalesce("c.date", F.lit("")) != "")
    newest = each.groupBy("ticker").agg(F.max_by("c", F.struct("c.date", (-F.col("place")).alias("back"))).alias("c"))
    number = lambda name: F.col(f"c.{name}").try_cast("int").alias({"fiscalYear": "year"}.get(name, name))
    return newest.select("ticker", F.col("c.date").alias("date"), number("fiscalYear"), number("quarter")).where("year is not null and quarter is not null")


def call_action(prior_date: Column, prior_title: Column, date: Column, quarter: Column, year: Column) -> Column:
    """What a fetched call is to the stored one: unchanged (same date, to be tried again), a replacement (same period
    in the title), or new evidence beside it."""
    period = r"\bQ(\d)\s+(\d{4})\b"
    same = (F.regexp_extract(prior_title, period, 1) == quarter.cast("string")) & (F.regexp_extract(prior_title, period, 2) == year.cast("string"))
    return F.when(F.substring(prior_date, 1, 10) == date, "unchanged").when(same, "supersedes").otherwise("new")


def encyclopedia(rows: DataFrame) -> DataFrame:
    """ticker, title, url, body of the first page (in the order of search terms) whose summary is long enough."""
    shape = "ARRAY<STRUCT<title: STRING, url: STRING, summary: STRING, content: STRING>>"
    fit = F.filter(part("$", shape), lambda p: F.length(p["summary"]) >= LEAST_SUMMARY)
    found = rows.select("ticker", F.get(fit, F.lit(0)).alias("p")).where("p is not null")
    body = F.concat(F.lit("## Summary\n\n"), F.col("p.summary"), F.lit("\n\n## Full article\n\n"), F.coalesce("p.content", F.lit("")))
    return found.select("ticker", "p.title", "p.url", body.alias("body"))


def topic_outcome(rows: DataFrame) -> DataFrame:
    """ticker, written, failed, ok of answers by topic (ticker, topic, content): any answer that isn't blank is success."""
    good = F.coalesce(F.col("content"), F.lit("")).rlike(r"\S")
    counts = rows.groupBy("ticker").agg(F.count(F.when(good, 1)).alias("written"), F.count(F.when(~good, 1)).alias("failed"))
    return counts.withColumn("ok", F.col("written") > 0)


def section_problems(config: DataFrame) -> DataFrame:
    """place, problem of a section list (place, section, seeds): each place names its section, with four to six seeds.

    Sections are a fixed few, so the list of them is part of the plan.
    """
    expected = F.get(F.array(*[F.lit(s) for s in SECTIONS]), F.col("place"))
    order = F.when(~F.col("section").eqNullSafe(expected), "order")
    seeds = F.when(~F.coalesce(F.col("seeds"), F.lit(0)).between(*SEEDS), "seeds")
    return config.select("place", F.explode(F.array_compact(F.array(order, seeds))).alias("problem"))


def ledger(rows: DataFrame) -> DataFrame:
    """ticker, hash, section, status, attempts of question ledgers; a missing ledger is an empty one."""
    shape = "ARRAY<STRUCT<hash: STRING, section: STRING, status: STRING, attempts: INT>>"
    return rows.select("ticker", F.inline(part("$", shape)))


def matter(text: Column, name: str) -> Column:
    """A scalar field of a text's front matter, quotes dropped; null if it is empty or isn't there."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.nullif(F.btrim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1), F.lit(" '\"")), F.lit(""))


def task_logs(files: DataFrame) -> DataFrame:
    """run, name, place, purpose, section, label, round, started_at, status of log files (run, name, text).

    A log without a readable front matter is kept with what can be said of it. Dated logs come first, then by name.
    """
    field = lambda n: matter(F.col("text"), n)
    read = files.select("run", "name", F.coalesce(field("purpose"), F.lit("unknown")).alias("purpose"), field("section").alias("section"), F.coalesce(field("label"), "name").alias("label"), field("round").try_cast("int").alias("round"), F.coalesce(field("started_at"), F.lit("")).alias("started_at"), F.coalesce(field("status"), F.lit("ok")).alias("status"))
    order = Window.partitionBy("run").orderBy(F.col("started_at") == "", "started_at", "name")
    return read.withColumn("place", F.row_number().over(order).cast("long"))


def latest_verdict(runs: DataFrame) -> DataFrame:
    """ticker, run, payload of the newest run whose verdict is a JSON object; a run marked latest goes before all others."""
    usable = runs.where(F.startswith(F.ltrim("payload"), F.lit("{")) & F.try_parse_json("payload").isNotNull())
    newest = F.max(F.struct(F.coalesce("latest", F.lit(False)).alias("first"), "run", "payload")).alias("v")
    return usable.groupBy("ticker").agg(newest).select("ticker", "v.run", "v.payload")
