"""Texts of pages, filings and reports: blocks of HTML, boilerplate, summaries, marked cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnbeck.functions import text as T

# Elements without prose, elements that end a block, and openers of a page that tell of its assignment.
DROPPED = ("script", "style", "noscript", "template", "svg", "head")
BLOCKS = "p div li td th dd dt blockquote pre h1 h2 h3 h4 h5 h6 figcaption article section main body header footer nav aside tr ul ol dl table br hr form fieldset address details summary".split()
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
PREAMBLE = r"(?:scope|persona|working notes|period convention|one-line frame|fiscal (?:note|year)|frontmatter note|the one framing fact|read this page|these are|this page)\b"
# Boilerplate of filings.
FORWARD_PARAGRAPH = r"(?i)(?:This|The)\s+(?:report|document|filing|quarterly report|annual report)[^\n]*?forward[- ]looking\s+statements[^\n]*?(?:Private\s+Securities\s+Litigation\s+Reform\s+Act|Securities\s+Act)[^\n]*\."
FORWARD_SECTION = r"(?i)Forward[- ]Looking\s+Statements?\s*\n(?:[^\n]*\n){0,30}?(?:(?:undue\s+reliance|actual\s+results\s+may\s+differ|we\s+undertake\s+no\s+obligation)[^\n]*\.)"
COVER = r"(?is)(?:UNITED\s+STATES\s*\n\s*SECURITIES\s+AND\s+EXCHANGE\s+COMMISSION|FORM\s+8-K\s*\n\s*CURRENT\s+REPORT).*?(\n\s*Item\s+\d|\z)"
SIGNATURE = r"(?is)(?:\A|\n)\s*SIGNATURES?\s*\n.*"
EXHIBITS = r"(?is)(?:\A|\n)\s*(?:EXHIBIT\s+INDEX|Item\s+9\.01[^\n]*Exhibits?)\s*\n.*"
SIGNED_CELL = r"\|(\s*)(\**)([+\-−])([\d.,]+\s*(?:%|x|×|bps?|pp|[BMKT]n?)?)(\**)\s*(?=\|)"


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_title(html: Column) -> Column:
    """The first title with text, white space collapsed; null without one."""
    titles = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<title\b[^>]*>(.*?)</title"), F.lit(1)), lambda x: F.btrim(F.regexp_replace(_decoded(x), r"\s+", " ")))
    return F.get(F.filter(titles, lambda x: x != ""), F.lit(0))


def html_blocks(html: Column) -> Column:
    """The text of a page, blocks separated by an empty line, without elements that hold no prose."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\x01")
    out = F.regexp_replace(out, r"</?[a-zA-Z!?][^>]*>", "")
    parts = F.transform(F.split(out, "\x01"), lambda x: F.btrim(F.regexp_replace(_decoded(x), r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def without_boilerplate(text: Column, form: Column) -> Column:
    """Filing text without forward-looking disclaimers; an 8-K also without cover, signatures and exhibit index."""
    plain = F.regexp_replace(F.regexp_replace(text, FORWARD_PARAGRAPH, ""), FORWARD_SECTION, "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, COVER, "$1"), SIGNATURE, ""), EXHIBITS, "")
    out = F.when(F.upper(form) == "8-K", short).otherwise(plain)
    return T.stripped(F.regexp_replace(out, "\n{3,}", "\n\n"))


def shortened(text: Column, limit: int = 140) -> Column:
    """The first sentence, cut at a word to the limit with an ellipsis."""
    sentence = T.stripped(F.regexp_extract(text, r"(?s)\A(.*?(?:[.!?]\s|\z))", 1))
    cut = F.regexp_replace(F.regexp_replace(F.substring(sentence, 1, limit), r" [^ ]*\z", ""), r"[,;:]+\z", "")
    return F.when(F.length(sentence) <= limit, sentence).otherwise(F.concat(cut, F.lit("…")))


def summary(declared: Column, body: Column) -> Column:
    """One line on a page: the declared one, else the first block whose first sentence reads like one, else empty.

    Headings, tables, lists, citations, tags and emphasis don't count, nor do leading sentences on the assignment.
    """

    def candidate(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), T.stripped), lambda x: (x != "") & ~x.rlike(r"^(?:[#|>-]|\d+[.)]\s)"))
        text = F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), T.CITATION, " "), T.STATUS, "")
        text = F.regexp_replace(text, r"\*\*|__", "")
        text = T.stripped(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s+([.,;:)])", "$1"))
        text = F.regexp_replace(text, rf"(?i)\A(?:{PREAMBLE}[^.!?:]*(?:[.!?:]+[^\s.!?:][^.!?:]*)*[.!?:]+(?:\s+|\z))+", "")
        return shortened(F.when(text.rlike(rf"(?i)\A{PREAMBLE}"), "").otherwise(text))

    like = lambda x: (F.length(x) >= 40) & (T.word_count(x) >= 6) & x.rlike(r"^[A-Z(\"']") & ~F.endswith(x, F.lit(":"))
    found = F.get(F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\n\s*\n"), candidate), like), F.lit(0))
    own = T.stripped(F.coalesce(declared, F.lit("")))
    return F.when(own != "", shortened(own)).otherwise(F.coalesce(found, F.lit("")))


def marked_cells(markdown: Column) -> Column:
    """Signed figures that fill a table cell, as spans with their sign as class."""
    negative = F.regexp_replace(markdown, SIGNED_CELL.replace(r"[+\-−]", r"[\-−]"), '| $2<span class="num neg">$3$4</span>$5 ')
    return F.regexp_replace(negative, SIGNED_CELL.replace(r"[+\-−]", r"\+"), '| $2<span class="num pos">$3$4</span>$5 ')


def ownership(table: Column, sections: list[str]) -> Column:
    """Map of fact phrases of two words or more to the section that owns them, from rows `| facts | §N Name |`."""
    names = F.array(*[F.lit(s) for s in sections])
    owned = F.transform(F.regexp_extract_all(table, F.lit(r"(?m)^\|\s*([^|\n]+?)\s*\|\s*§\d[^|\n]*\|\s*$"), F.lit(1)), lambda x: x)
    index = F.regexp_extract_all(table, F.lit(r"(?m)^\|\s*[^|\n]+?\s*\|\s*§(\d)[^|\n]*\|\s*$"), F.lit(1))
    pairs = F.flatten(F.zip_with(owned, index, lambda facts, i: F.transform(F.split(facts, ","), lambda p: F.struct(F.lower(T.stripped(p)).alias("phrase"), F.get(names, i.cast("int") - 1).alias("section")))))
    return F.filter(pairs, lambda p: (T.word_count(p["phrase"]) >= 2) & p["section"].isNotNull())


def narrowed(value: Column) -> Column:
    """A finite number, else null."""
    n = value.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def rgba(colour: Column, alpha: float) -> Column:
    """`#rrggbb` as rgba(); null for other shapes."""
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10)
    return F.when(colour.rlike("^#[0-9a-fA-F]{6}$"), F.concat(F.lit("rgba("), F.concat_ws(",", part(2), part(4), part(6), F.lit(str(alpha))), F.lit(")")))
