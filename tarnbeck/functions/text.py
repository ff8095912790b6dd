"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that results depend on.
CITATION = r"\[\^([A-Za-z0-9][\w.\-]*)\]"
NUMBER = r"\$\s*\d[\d,.]*|\d[\d,.]*\s*%|\b\d{1,3}(?:,\d{3})+\b|\b\d+\.\d+\b"
FORWARD = r"FY\d{2}|Q[1-4]\b|\b20(?:2[6-9]|3\d)\b"
STATUS = r"\[(REPORTED|GUIDANCE|CONSENSUS|ESTIMATE)\b[^\]]*\]"
QUERY_TOKEN = r"[a-z0-9][a-z0-9&/.\-]*"
SUFFIX = r"(?i)[,\s]+(inc|corp|corporation|company|co|ltd|plc|llc|holdings|group)\.?$"


def slug(text: Column) -> Column:
    """Lower-case, other than letters, digits and hyphens as one hyphen, none at the ends, 60 characters."""
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9-]", "-"), "-+", "-"), F.lit("-")), 1, 60)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def question_hash(section: Column, question: Column) -> Column:
    """Ten hex digits that name a question of a section, whatever its case and white space around it."""
    return F.substring(F.sha1(F.concat(section, F.lit("|"), F.lower(stripped(question)))), 1, 10)


def date_part(stamp: Column) -> Column:
    """The date of an ISO time stamp; a bare date stays, null is empty."""
    return F.split(F.coalesce(stamp, F.lit("")), "T")[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def query_terms(question: Column, stop_words: list[str]) -> Column:
    """Search terms of a question, in the order of their first appearance."""
    tokens = F.transform(F.regexp_extract_all(F.lower(question), F.lit(f"({QUERY_TOKEN})"), F.lit(1)), lambda t: F.btrim(t, F.lit(".-/&")))
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def one_line(text: Column, limit: int = 100) -> Column:
    """The first line with something on it, white space collapsed."""
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")
    return F.substring(F.regexp_replace(stripped(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), r"\s+", " "), 1, limit)


def citations(text: Column) -> Column:
    """Cited ids in order of first appearance; a definition (marker and colon) cites nothing."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION + "(?!:)"), F.lit(1)))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]+)", 1))


def site_name(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def host_matches(url: Column, suffix: str) -> Column:
    return (host(url) == suffix) | F.endswith(host(url), F.lit("." + suffix))


def artifact_free(text: Column) -> Column:
    """Filing text without tags, with basic entities decoded, and runs of blanks shortened."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "&#?[a-zA-Z0-9]+;", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, " {3,}", " "), "\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def money(value: Column) -> Column:
    """With T, B, M or K."""
    def scaled(by: float, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", value / F.lit(by)), F.lit(unit))

    size = F.abs(value)
    return F.when(size >= 1e12, scaled(1e12, "T")).when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(F.format_string("%.1f", value))


def short_company(name: Column, limit: int = 26) -> Column:
    return F.substring(F.regexp_replace(name, SUFFIX, ""), 1, limit)


def truncated(text: Column, lines: int = 40, chars: int = 3000) -> Column:
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), 1, chars)
