"""Gates over a corpus: layers, commands, names, citations, references, lints, and their ordered union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import provenance as P
from tarnbeck.operators.credentials import credential_names  # noqa: F401

# Kinds of sources, names of tickers, limits of texts.
SOURCE_KINDS = ("sec_filing", "wikipedia", "news", "perplexity_research", "transcript", "web_page", "press_release", "analyst_note", "other")
MODEL_KINDS = ("research_answer",)
TICKER, SHARED = r"^[A-Z][A-Z0-9.-]{0,9}$", "_MACRO"
LEAST_CHARS = {"filing": 50, "summary": 100, "page": 400}
ANCHOR = r'href="#ref-(\d+)"'
# What no report shows its reader.
MACHINERY = {
    "css comment": r"/\*.*?\*/",
    "css at-rule": r"@(?:media|page|font-face|import|supports|keyframes)\b",
    "css custom property": r"--[a-z][a-z0-9-]*\s*:\s*[^;\n]{1,60};",
    "css declaration block": r"\{[^{}]*?[a-z-]{3,}\s*:\s*[^{};]{1,60}[;}]",
    "unrendered jinja expression": r"\{\{.{0,80}?\}\}",
    "unrendered jinja statement": r"\{%.{0,80}?%\}",
    "literal html comment": r"<!--.{0,80}?-->",
}
EXCERPT, EXCERPTS = 90, 3


def layer_problems() -> dict[str, Column]:
    """Of a source's kind: model output and unknown kinds don't belong among sources."""
    kind = F.coalesce(F.col("kind"), F.lit(""))
    return {"model kind": kind.isin(*MODEL_KINDS), "unknown kind": ~kind.isin(*SOURCE_KINDS, *MODEL_KINDS)}


def command_problem(producer: Column, command: Column, bronze: Column) -> Column:
    """A model's artifact has no command that fetches it, every other one has."""
    has = F.coalesce(command, F.lit("")) != ""
    missing = F.when(bronze, "bronze without fetch_cmd").otherwise("silver without fetch_cmd")
    return F.when(producer.eqNullSafe("model"), F.when(has, "model with fetch_cmd")).when(~has, missing)


def good_ticker(name: Column) -> Column:
    return (name == SHARED) | name.rlike(TICKER)


def bare_name(name: Column) -> Column:
    """Whether a name stays in its folder."""
    return ~(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")) | (name == "..") | (name == ".") | (name == ""))


def long_enough(kind: Column, text: Column) -> Column:
    """Whether a text has the characters that its kind needs; kinds without a limit always have."""
    least = F.element_at(F.create_map(*[x for k, n in LEAST_CHARS.items() for x in (F.lit(k), F.lit(n))]), kind)
    return F.coalesce(F.length(T.stripped(F.coalesce(text, F.lit("")))) >= least, F.lit(True))


def prose_excess(text: Column, limit: int) -> Column:
    """Characters over the limit, citation markers not counted; null within it."""
    n = F.length(T.without_citations(text))
    return F.when(n > limit, (n - limit).cast("long"))


def over_budget(drafts: DataFrame, baseline: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """keys, words, budget of groups of drafts (keys, body) with more words than the baseline's times the factor.

    A group without a baseline is over any budget, with a null one.
    """
    mine = drafts.groupBy(*keys).agg(F.sum(T.word_count(F.col("body"))).alias("words"))
    theirs = baseline.groupBy(*keys).agg(F.floor(F.sum(T.word_count(F.col("body"))) * F.lit(factor)).cast("long").alias("budget"))
    both = mine.join(theirs, keys, "left")
    return both.where(F.col("budget").isNull() | (F.col("words") > F.col("budget")))


def visible(html: Column) -> Column:
    """Text outside of tags, style sheets and scripts. A comment's text is markup and stays for the lint."""
    bare = F.regexp_replace(html, r"(?is)<(?:style|script)\b[^>]*>.*?</(?:style|script)\s*>", "")
    return F.regexp_replace(bare, r"(?s)</?[a-zA-Z][^>]*>", "")


def machinery(pages: DataFrame) -> DataFrame:
    """id, rule, excerpt of what a page (id, html) shows of its making: up to EXCERPTS different excerpts a rule."""
    text = visible(F.col("html"))

    def excerpts(pattern: str) -> Column:
        flat = F.transform(F.regexp_extract_all(text, F.lit(f"(?is)({pattern})"), F.lit(1)), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
        cut = F.transform(flat, lambda x: F.when(F.length(x) > EXCERPT, F.concat(F.substring(x, 1, EXCERPT - 1), F.lit("…"))).otherwise(x))
        return F.slice(F.array_distinct(cut), 1, EXCERPTS)

    rules = F.array(*[F.struct(F.lit(n).alias("rule"), excerpts(p).alias("found")) for n, p in MACHINERY.items()])
    found = pages.select("id", F.explode(rules).alias("r")).select("id", "r.rule", F.explode("r.found").alias("excerpt"))
    opened, closed = (F.regexp_count(F.col("html"), F.lit(p)) for p in (r"(?i)<style\b", r"(?i)</style\b"))
    unequal = pages.where(opened != closed).select("id", F.lit("unbalanced style").alias("rule"), F.concat_ws(" ", opened, closed).alias("excerpt"))
    return found.union(unequal)


def unresolved_citations(pages: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """id, cid, layer of citations that don't end at bronze."""
    return P.resolve(P.cited(pages), own, shared).where("layer <> 'bronze'")


def report_citations(reports: DataFrame, mapped: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """id, cid, problem of assembled reports (id, body): anchors' numbers go through the map (id, number, artifact); a
    report without any map is one finding."""
    cids = F.array_distinct(F.concat(F.regexp_extract_all("body", F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all("body", F.lit(T.CITATION), F.lit(1))))
    cited = reports.select("id", F.explode(cids).alias("cid"))
    with_map = mapped.select("id").distinct()
    bare = cited.join(with_map, "id", "left_anti").select("id").distinct().select("id", F.lit(None).cast("string").alias("cid"), F.lit("no map").alias("problem"))
    named = cited.join(with_map, "id", "left_semi").join(mapped.select("id", F.col("number").alias("cid"), F.col("artifact").alias("target")), ["id", "cid"], "left")
    number = F.col("cid").rlike("^[0-9]+$")
    unmapped = named.where(number & F.col("target").isNull()).select("id", "cid", F.lit("not in the map").alias("problem"))
    there = named.where(~number | F.col("target").isNotNull()).select("id", F.col("cid").alias("as_cited"), F.when(number, F.col("target")).otherwise(F.col("cid")).alias("cid"))
    wrong = P.resolve(there, own, shared).where("layer <> 'bronze'").select("id", F.col("as_cited").alias("cid"), F.col("layer").alias("problem"))
    return bare.union(unmapped).union(wrong)


def ordered_union(*checks: DataFrame) -> DataFrame:
    """Findings (path, problem) of all checks with `check`, the check's place."""
    return reduce(DataFrame.union, [c.select(F.lit(i).cast("long").alias("check"), "path", "problem") for i, c in enumerate(checks)])


def missing_kinds(state: DataFrame, artifacts: DataFrame) -> DataFrame:
    """kind of the state's entries (kind, current_id) with an id that no artifact has."""
    return state.join(artifacts.select(F.col("artifact").alias("current_id")), "current_id", "left_anti").select("kind").distinct()


def harvest_targets(cited: DataFrame, mapped: DataFrame, retry_failed: bool = False) -> DataFrame:
    """answer whose cited urls (answer, url) aren't all keys of its map (answer, url, source); with a retry also those
    with a null source."""
    keys = mapped.where("source is not null") if retry_failed else mapped
    return cited.join(keys.select("answer", "url"), ["answer", "url"], "left_anti").select("answer").distinct()


def added(ledger: DataFrame, proposed: DataFrame) -> DataFrame:
    """section, question, qhash of proposed questions (ord, section, question) that the ledger (section, question)
    doesn't hold yet: the first of equal ones, blank ones left out."""
    known = ledger.select(T.question_hash(F.col("section"), F.col("question")).alias("qhash")).distinct()
    text = proposed.withColumn("question", T.stripped(F.col("question"))).where("question <> ''")
    new = text.withColumn("qhash", T.question_hash(F.col("section"), F.col("question"))).join(known, "qhash", "left_anti")
    return new.groupBy("qhash").agg(F.min_by(F.struct("section", "question"), F.struct("ord", "question")).alias("q")).select("q.section", "q.question", "qhash")


def collisions(ledger: DataFrame) -> DataFrame:
    """qhash under which different questions stand."""
    own = ledger.select(T.question_hash(F.col("section"), F.col("question")).alias("qhash"), F.struct("section", F.lower(T.stripped(F.col("question")))).alias("q"))
    return own.groupBy("qhash").agg(F.min("q").alias("a"), F.max("q").alias("b")).where("a <> b").select("qhash")


def after_attempts(ledger: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """qhash, attempts, status after the attempts (qhash): an open question is deferred at `most`, a closed one stays."""
    more = attempts.groupBy("qhash").agg(F.count(F.lit(1)).alias("more"))
    now = F.col("attempts") + F.coalesce("more", F.lit(0))
    tried = F.col("more").isNotNull() & F.col("status").isin("open", "reopened") & (now >= most)
    return ledger.join(more, "qhash", "left").select("qhash", now.alias("attempts"), F.when(tried, "deferred").otherwise(F.col("status")).alias("status"))


def applied(ledger: DataFrame, reopened: DataFrame, revived: DataFrame) -> DataFrame:
    """qhash, status after an invalidation; a second time changes nothing."""
    a, b = reopened.select("qhash", F.lit("reopened").alias("_a")).distinct(), revived.select("qhash", F.lit("open").alias("_b")).distinct()
    return ledger.join(a, "qhash", "left").join(b, "qhash", "left").select("qhash", F.coalesce("_b", "_a", "status").alias("status"))


def dirty_sections(state: DataFrame, marks: DataFrame) -> DataFrame:
    """section, place: the state's dirty sections (section, ord), then newly marked ones (section, ord), each once."""
    both = state.select("section", F.lit(0).alias("_side"), "ord").union(marks.select("section", F.lit(1), "ord"))
    first = both.groupBy("section").agg(F.min(F.struct("_side", "ord")).alias("f"))
    # The sections are a short closed list.
    return first.select("section", F.row_number().over(Window.orderBy("f", "section")).cast("long").alias("place"))


def stale_ranking(rankings: DataFrame, candidates: DataFrame) -> DataFrame:
    """grp, usable of rankings (grp, ranked_at): not one from before its candidates (grp, changed_at) last changed."""
    return rankings.join(candidates, "grp", "left").select("grp", F.coalesce(F.col("ranked_at") >= F.col("changed_at"), F.col("ranked_at").isNotNull()).alias("usable"))
