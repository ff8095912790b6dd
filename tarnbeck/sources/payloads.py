"""Recorded answers of data providers as tables. An answer is one JSON text a ticker (columns ticker, payload).

Answers that aren't JSON, halves of another shape and null fields count as missing; a ticker whose answer holds nothing
usable has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.operators import statements as S

# Names of the forward periods, fields of a profile, caps on rating actions, articles and ownership rows,
# fields that date a row, keys in query strings.
PERIODS = {"0q": "current_quarter", "+1q": "next_quarter", "0y": "current_fiscal_year", "+1y": "next_fiscal_year"}
PROFILE = "longName STRING, sector STRING, industry STRING, longBusinessSummary STRING, website STRING, country STRING, fullTimeEmployees BIGINT, marketCap BIGINT, currency STRING"
ACTIONS, ARTICLES = 25, 20
OWNERSHIP = {"institutional": 20, "insider_trading": 60, "short_interest": 26}
DATES = ["settlement_date", "transaction_date", "filing_date", "period_ending", "date"]
SECRETS = r"""(?i)\b(apikey|api_key|apiKey|token|access_token|key)=[^&;\s"'>]*"""
REDACTED = "REDACTED"
AGO = {"7d": "7daysAgo", "30d": "30daysAgo", "60d": "60daysAgo", "90d": "90daysAgo"}


def part(path: str, schema: str) -> Column:
    """A part of the answer in its shape, null where it has another."""
    text = F.get_json_object("payload", path)
    # An object would be read as a list of one.
    return F.from_json(F.when(F.startswith(text, F.lit("[")), text) if schema.startswith("ARRAY") else text, schema)


def profiles(rows: DataFrame) -> DataFrame:
    """ticker and the fields of a company profile; an answer without a company name is no profile."""
    found = rows.select("ticker", F.from_json("payload", PROFILE).alias("p")).select("ticker", "p.*")
    return found.where(F.coalesce(F.col("longName"), F.lit("")) != "")


def period_name(key: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, key), key)


def estimate_trends(rows: DataFrame) -> DataFrame:
    """ticker, period, current, revision_pct_7d and so on: how far the consensus of each forward period has moved."""
    shape = ", ".join(f"{k}: DOUBLE" for k in ["current", *[f"`{x}`" for x in AGO.values()]])
    periods = rows.select("ticker", F.explode(part("$.eps_trend", f"MAP<STRING, STRUCT<{shape}>>")).alias("key", "v"))
    moved = [S.change(F.col("v.current"), F.col(f"v.`{x}`")).alias(f"revision_pct_{name}") for name, x in AGO.items()]
    return periods.select("ticker", period_name(F.col("key")).alias("period"), F.col("v.current").alias("current"), *moved)


def price_targets(rows: DataFrame) -> DataFrame:
    """ticker, current and the targets with their upside in percent; null where the current price is missing or zero."""
    kinds = ["mean", "median", "high", "low"]
    found = rows.select("ticker", part("$.price_targets", "STRUCT<current: DOUBLE, mean: DOUBLE, median: DOUBLE, high: DOUBLE, low: DOUBLE>").alias("p")).select("ticker", "p.*")
    upside = [S.percent(F.try_divide(F.col(k) - F.col("current"), F.col("current"))).alias(f"upside_pct_{k}") for k in kinds]
    return found.where(F.coalesce("current", *kinds).isNotNull()).select("*", *upside)


def rating_actions(rows: DataFrame, limit: int = ACTIONS) -> DataFrame:
    """ticker, date, firm, grade of each ticker's newest `limit` rating actions; equal dates in the answer's order."""
    shape = "ARRAY<STRUCT<date: STRING, Firm: STRING, ToGrade: STRING>>"
    each = rows.select("ticker", F.posexplode(part("$.upgrades_downgrades", shape)).alias("place", "a"))
    newest = Window.partitionBy("ticker").orderBy(F.desc("a.date"), "place")
    return each.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit).select("ticker", "n", "a.date", F.col("a.Firm").alias("firm"), F.col("a.ToGrade").alias("grade"))


def earnings_dates(rows: DataFrame) -> DataFrame:
    """ticker, date, estimate, reported of every quarter in an events calendar."""
    shape = "MAP<STRING, STRUCT<`EPS Estimate`: DOUBLE, `Reported EPS`: DOUBLE>>"
    each = rows.select("ticker", F.explode(part("$.earnings_dates", shape)).alias("date", "v"))
    return each.select("ticker", "date", F.col("v.`EPS Estimate`").alias("estimate"), F.col("v.`Reported EPS`").alias("reported"))


def published_series(rows: DataFrame) -> DataFrame:
    """ticker, title, as_of (date of the last observation) and the number of observations of a published series."""
    seen = rows.select("ticker", F.get_json_object("payload", "$.series.title").alias("title"), part("$.observations", "ARRAY<STRUCT<date: STRING, value: STRING>>").alias("o"))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("FRED "), F.col("ticker")))
    return seen.where(F.size("o") > 0).select("ticker", title.alias("title"), F.element_at("o", -1)["date"].alias("as_of"), F.size("o").cast("long").alias("n"))


def articles(rows: DataFrame, limit: int = ARTICLES) -> DataFrame:
    """ticker, place, title, url, publisher, published of the first `limit` items of a news answer, of either shape.

    The flat shape gives its time in seconds. Items without a title or an address fall away.
    """
    nested = "STRUCT<title: STRING, canonicalUrl: STRUCT<url: STRING>, provider: STRUCT<displayName: STRING>, pubDate: STRING>"
    shape = f"ARRAY<STRUCT<content: {nested}, title: STRING, link: STRING, publisher: STRING, providerPublishTime: BIGINT>>"
    items = rows.select("ticker", F.posexplode(part("$", shape)).alias("place", "i")).where(F.col("place") < limit)
    deep = F.col("i.content").isNotNull()
    stamp = F.date_format(F.timestamp_seconds("i.providerPublishTime"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    either = lambda a, b: F.when(deep, F.col(a)).otherwise(b)
    empty = lambda x: F.coalesce(x, F.lit(""))
    out = items.select("ticker", "place", either("i.content.title", F.col("i.title")).alias("title"), either("i.content.canonicalUrl.url", F.col("i.link")).alias("url"), empty(either("i.content.provider.displayName", F.col("i.publisher"))).alias("publisher"), empty(either("i.content.pubDate", stamp)).alias("published"))
    return out.where((empty(F.col("title")) != "") & (empty(F.col("url")) != ""))


def statement_items(rows: DataFrame, statement: str) -> DataFrame:
    """ticker, period, item, value of a statement kept as {period: {item: value}}."""
    periods = rows.select("ticker", F.explode(part(f"$.{statement}", "MAP<STRING, MAP<STRING, DOUBLE>>")).alias("period", "items"))
    return periods.select("ticker", "period", F.explode("items").alias("item", "value"))


def computed_multiples(rows: DataFrame) -> DataFrame:
    """ticker, enterprise value from market cap, debt and cash, its multiples of revenue and EBITDA, and whether the
    provider's own value differs from it; only for answers that have all three."""
    fields = ["market_cap", "total_debt", "total_cash", "revenue_ttm", "ebitda", "enterprise_value"]
    found = rows.select("ticker", part("$.highlights", ", ".join(f"{f} DOUBLE" for f in fields)).alias("h")).select("ticker", "h.*")
    known = found.where(F.col("market_cap").isNotNull() & F.col("total_debt").isNotNull() & F.col("total_cash").isNotNull())
    value = S.enterprise_value(F.col("market_cap"), F.col("total_debt"), F.col("total_cash"))
    own = F.when(F.col("enterprise_value") != 0, F.col("enterprise_value"))
    multiples = [F.round(F.try_divide(value, F.col(f)), 3).alias(name) for f, name in (("revenue_ttm", "ev_to_revenue"), ("ebitda", "ev_to_ebitda"))]
    return known.select("ticker", value.alias("ev"), *multiples, S.diverges(value, own).alias("diverges"))


def newest_rows(rows: DataFrame, caps: dict[str, int] = OWNERSHIP) -> DataFrame:
    """ticker, dataset, n, date of each dataset's newest rows, as many as its cap. Rows are dated by the first of DATES
    that the dataset's first row has; without any the answer's order stands, as it does for equal dates. Rows without
    their date come last."""
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    sets = rows.select("ticker", F.explode(part("$.data", "MAP<STRING, ARRAY<MAP<STRING, STRING>>>")).alias("dataset", "rows")).where(F.col("dataset").isin(*caps))
    first = F.get("rows", F.lit(0))
    field = F.coalesce(*[F.when(F.map_contains_key(first, d), F.lit(d)) for d in DATES])
    each = sets.withColumn("field", field).select("ticker", "dataset", "field", F.posexplode("rows").alias("place", "r"))
    newest = Window.partitionBy("ticker", "dataset").orderBy(F.desc_nulls_last("date"), "place")
    ranked = each.select("ticker", "dataset", "place", F.try_element_at("r", F.col("field")).alias("date")).withColumn("n", F.row_number().over(newest))
    return ranked.where(F.col("n") <= cap[F.col("dataset")]).select("ticker", "dataset", "n", "date")


def peer_symbols(rows: DataFrame) -> DataFrame:
    """ticker, place, symbol of a list of peers; entries without a symbol fall away."""
    each = rows.select("ticker", F.posexplode(part("$", "ARRAY<STRUCT<symbol: STRING>>")).alias("place", "p"))
    return each.where(F.coalesce("p.symbol", F.lit("")) != "").select("ticker", "place", "p.symbol")


def exposures(rows: DataFrame) -> DataFrame:
    """ticker, fund, weight (a share, from percent) and market value of the funds that hold a ticker; nulls stay null."""
    each = rows.select("ticker", F.explode(part("$", "ARRAY<STRUCT<symbol: STRING, weightPercentage: DOUBLE, marketValue: DOUBLE>>")).alias("f"))
    return each.select("ticker", F.col("f.symbol").alias("fund"), (F.col("f.weightPercentage") / 100).alias("weight"), F.col("f.marketValue").alias("market_value"))


def without_secrets(text: Column) -> Column:
    """Text with the values of keys in query strings replaced."""
    return F.regexp_replace(text, SECRETS, "$1=" + REDACTED)
