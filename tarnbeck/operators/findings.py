"""Checks that report findings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions import text as T

# Patterns and limits of the checks.
SECRETS = {
    "sk_key": r"(?:^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}",
    "hex32": r"\b[0-9a-f]{32}\b",
    "hex_with_word": r"(?i)(?:key[\s\S]{0,37}|token[\s\S]{0,35}|secret[\s\S]{0,34})\b[0-9a-f]{32}\b",
    "url_credential": r"(?i)[?&](?:apikey|api_key|access_token|token)=[^&\s\"'\\]+",
}
INTERNAL = (r"\b[\w.-]+\.json\b", r"\b(?:structured|derived|sources|wiki|charts)/", r"\bdata/[A-Z][A-Z0-9.-]{0,9}\b", r"\b00_manifest\b")
THIN, BLOCK_CHARS, MOST_CHARS = 400, 300, 1_500_000
BLOCK_WORDS = (
    "access denied", "access to this page has been denied",
    "page not found", "404 - page not found", "error 404",
    "just a moment", "are you a robot", "attention required",
    "security screening", "enhanced security", "captcha",
    "authentication failed", "please enable javascript", "request blocked",
    "forbidden", "too many requests", "rate limit",
)
ESCALATE = (
    "transport_error", "too_many_redirects", "redirect_without_location",
    "thin_content", "blocked_page",
    "playwright_unavailable", "playwright_error", "playwright_timeout",
    "brightdata_unavailable", "brightdata_error", "brightdata_status", "brightdata_empty",
    "tier_error",
)


def listed(problems: dict[str, Column]) -> Column:
    """Names of the conditions that hold."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()]), lambda p: p.isNotNull())


def findings(rows: DataFrame, keys: list[str], problems: dict[str, Column]) -> DataFrame:
    return rows.select(*keys, F.explode(listed(problems)).alias("problem"))


def secret_findings(docs: DataFrame) -> DataFrame:
    """One row per document and kind of secret; the value is never shown."""
    return findings(docs, ["id"], {n: F.col("body").rlike(p) for n, p in SECRETS.items()})


def producer_problems() -> dict[str, Column]:
    """A fetched document needs a command and a time, a computed one its inputs, a model's answer neither command."""
    fetched, computed, model = (F.col("producer") == p for p in ("fetch", "compute", "model"))
    return {
        "fetch_cmd missing": fetched & F.col("fetch_cmd").isNull(),
        "fetched_at missing": fetched & F.col("fetched_at").isNull(),
        "derived_from missing": computed & (F.coalesce(F.size("derived_from"), F.lit(0)) <= 0),
        "fetch_cmd forbidden": model & F.col("fetch_cmd").isNotNull(),
        "unknown producer": ~(fetched | computed | model) | F.col("producer").isNull(),
    }


def paragraphs(pages: DataFrame) -> DataFrame:
    """id, par (from 0), paragraph."""
    return pages.select("id", F.posexplode(F.split("body", r"\n\s*\n")).alias("par", "paragraph")).withColumn("par", F.col("par").cast("long"))


def uncited_numbers(pages: DataFrame) -> DataFrame:
    """Paragraphs with a numeric claim and no citation."""
    p = paragraphs(pages)
    bare = T.without_citations(F.col("paragraph"))
    return p.where(bare.rlike(T.NUMBER) & ~F.col("paragraph").rlike(T.CITATION)).select("id", "par")


def untagged_forward_numbers(pages: DataFrame) -> DataFrame:
    p = paragraphs(pages)
    bare = T.without_citations(F.col("paragraph"))
    return p.where(bare.rlike(T.FORWARD) & bare.rlike(T.NUMBER) & ~bare.rlike(T.STATUS)).select("id", "par")


def internal_names(text: Column) -> Column:
    bare = T.without_citations(text)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(bare, F.lit(f"({p})"), F.lit(1)) for p in INTERNAL]))


def block_page(title: Column, body: Column) -> Column:
    """A title that names a wall, or so short a body with such a name in it."""
    marks = "|".join(BLOCK_WORDS)
    return F.lower(F.coalesce(title, F.lit(""))).rlike(marks) | ((F.length(body) <= BLOCK_CHARS) & F.lower(body).rlike(marks))


def page_verdict(title: Column, body: Column) -> Column:
    """ok, or why a page is no source; a long body is cut before it is judged."""
    cut = F.substring(body, 1, MOST_CHARS)
    return F.when(block_page(title, cut), "block_page").when(F.length(T.stripped(cut)) < THIN, "thin").otherwise("ok")


def escalatable(error: Column) -> Column:
    """Whether another way of fetching may help, by the code before the colon; without an error it doesn't."""
    reason = F.btrim(F.split(F.coalesce(error, F.lit("")), ":")[0])
    return reason.isin(*ESCALATE) | F.startswith(reason, F.lit("http_"))


def text_rules(drafts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule (rule_id, rule, value) on every draft (id, body); an unknown rule fails. The rules are a short list."""
    first = F.coalesce(F.get(F.filter(F.split("body", "\n"), lambda x: T.stripped(x) != ""), F.lit(0)), F.lit(""))
    number = F.expr("try_cast(value as bigint)")
    ok = (
        F.when(F.col("rule") == "startswith", F.startswith(first, F.col("value")))
        .when(F.col("rule") == "contains", F.contains("body", "value"))
        .when(F.col("rule") == "regex", F.expr("regexp_like(body, value)"))
        .when(F.col("rule") == "not_regex", ~F.expr("regexp_like(body, value)"))
        .when(F.col("rule") == "min_length", F.length("body") >= number)
        .when(F.col("rule") == "max_length", F.length("body") <= number)
        .otherwise(False)
    )
    return drafts.crossJoin(F.broadcast(rules)).select("id", "rule_id", ok.alias("passed"))
