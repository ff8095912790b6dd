"""What sinks write (sources with their archive, answers, artifacts, manifests, maps, indexes, journals), rules given as
strings, and the frames behind exhibits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators import gates as G
from tarnbeck.operators.findings import internal_names
from tarnbeck.operators.reports import cell

# Names of exhibits, days of a year of trading, weeks of a price exhibit.
EXHIBIT = r"^[a-z0-9][a-z0-9_-]*$"
TRADING_DAYS, WEEKS = 252, 209


def _once(rows: DataFrame) -> DataFrame:
    """Of rows with one id, the first by ord."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_n = 1").drop("_n")


def append_sources(held: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """id, kind, archived_on of the sources held (id, kind, archived_on) after the append of new ones (id, kind,
    supersedes, ord).

    Refused are kinds that aren't a source's, names that aren't bare, and ids that are held, archived or not. A held
    source that an accepted one supersedes is archived today; one that is archived already, or isn't there, stays so.
    """
    bare = G.bare_name(F.col("id")) & (F.col("supersedes").isNull() | G.bare_name(F.col("supersedes")))
    sound = _once(new.where(F.col("kind").isin(*G.SOURCE_KINDS) & bare))
    accepted = sound.join(held.select("id"), "id", "left_anti")
    replaced = accepted.where("supersedes is not null").select(F.col("supersedes").alias("id"), F.lit(True).alias("_r")).distinct()
    kept = held.join(replaced, "id", "left").withColumn("archived_on", F.coalesce("archived_on", F.when(F.col("_r"), F.lit(today).cast("date"))))
    return kept.select("id", "kind", "archived_on").unionByName(accepted.select("id", "kind", F.lit(None).cast("date").alias("archived_on")))


def append_answers(held: DataFrame, new: DataFrame) -> DataFrame:
    """id of the answers (id) after new ones (id, kind, ord): of a model's kind alone, with bare names, never overwritten."""
    sound = _once(new.where(F.col("kind").isin(*G.MODEL_KINDS) & G.bare_name(F.col("id"))))
    return held.select("id").unionByName(sound.join(held, "id", "left_anti").select("id"))


def upsert(held: DataFrame, new: DataFrame) -> DataFrame:
    """id, stamp, request of artifacts (the same columns) after an upsert: the newest stamp wins, of equal ones the new.

    Refused are artifacts of a model's making (producer) and those whose request carries a credential.
    """
    sound = new.where(F.col("producer").isin("fetch", "compute") & (F.size(G.credential_names(F.col("request"))) == 0))
    both = held.select("id", "stamp", "request", F.lit(0).alias("_new")).unionByName(sound.select("id", "stamp", "request", F.lit(1).alias("_new")))
    newest = F.max(F.struct("stamp", "_new", "request")).alias("m")
    return both.groupBy("id").agg(newest).select("id", "m.stamp", "m.request")


def table_line(*columns: Column) -> Column:
    """Columns as a line of a Markdown table."""
    shown = [cell(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def manifest_lines(rows: DataFrame) -> DataFrame:
    """ticker, place, line of a manifest (ticker, id, kind, as_of, bytes, summary): newest first, then by id."""
    order = Window.partitionBy("ticker").orderBy(F.desc("as_of"), "id")
    line = table_line(*[F.col(c) for c in ("id", "kind", "as_of", "bytes", "summary")])
    return rows.select("ticker", F.row_number().over(order).cast("long").alias("place"), line.alias("line"))


def url_map(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """answer, url, source of every cited address (answer, url), once: the newest page (url, id, stamp) or null."""
    newest = pages.groupBy("url").agg(F.max_by("id", F.struct("stamp", "id")).alias("source"))
    return cited.select("answer", "url").distinct().join(newest, "url", "left").select("answer", "url", "source")


def references(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """doc, number, id, line of a report's references (doc, number, id) over sources (id, title, source, url, fetched).

    A source without an address has none in its line; ids that resolve nowhere have a null line.
    """
    where = F.concat_ws(", ", "source", F.nullif(F.col("url"), F.lit("")))
    line = F.concat(F.lit("["), F.col("number"), F.lit("] "), F.concat_ws(" — ", "title", where, F.concat(F.lit("fetched "), T.date_part(F.col("fetched")))))
    known = sources.select("id", "title", "source", "url", "fetched", F.lit(True).alias("_k"))
    return cited.join(known, "id", "left").select("doc", "number", "id", F.when(F.col("_k"), line).alias("line"))


def exhibit_problems() -> dict[str, Column]:
    """A candidate exhibit has a plain name and at least one source."""
    return {"name": ~F.coalesce(F.col("name").rlike(EXHIBIT), F.lit(False)), "no sources": F.coalesce(F.size("data_sources"), F.lit(0)) <= 0}


def index_lines(pages: DataFrame, sections: list[str]) -> DataFrame:
    """ticker, place, line: a wiki index's table of sections, over pages (ticker, name, summary, updated, sources,
    questions, dirty). Sections without a page are shown as not written."""
    tickers = pages.select("ticker").distinct()
    listed = tickers.select("ticker", F.posexplode(F.array(*[F.lit(s) for s in sections])).alias("i", "name"))
    rows = listed.join(pages.withColumn("_w", F.lit(True)), ["ticker", "name"], "left")
    number = F.col("i") + 1
    link = F.concat(F.lit("["), F.col("name"), F.lit("]("), F.col("name"), F.lit(".md)"))
    written = table_line(number, link, F.col("summary"), F.substring("updated", 1, 10), F.col("sources"), F.col("questions"), F.when(F.col("dirty"), "dirty"))
    dash = [F.lit("—")] * 4
    return rows.select("ticker", number.cast("long").alias("place"), F.when(F.col("_w"), written).otherwise(table_line(number, F.col("name"), *dash, F.lit("not written"))).alias("line"))


def cost_note(agents: Column, tokens: Column, minutes: Column, run: Column) -> Column:
    """The second line of a journal entry, empty if nothing is known, with a link to the run's log if it has one."""
    counted = F.concat(agents, F.when(agents == 1, " agent").otherwise(" agents"))
    many = F.concat(F.format_number(F.bround(tokens / 1000, 0), 0), F.lit("k tok"))
    spent = F.when(tokens >= 1000, many).otherwise(F.concat(tokens, F.lit(" tok")))
    note = F.concat_ws(" · ", counted, spent, F.format_string("%.1f min", minutes))
    note = F.when(minutes.isNull(), F.concat_ws(" · ", counted, spent)).otherwise(note)
    return F.when((note != "") & run.isNotNull(), F.concat(F.lit("["), note, F.lit("](../reports/"), run, F.lit("/run_log.md)"))).otherwise(note)


def _rule(text: Column, rule: str) -> Column:
    """What is wrong with a text by one rule "name: value"; null if it passes. Unknown and malformed rules never pass."""
    name, sep, value = rule.partition(": ")
    if not sep and rule.strip() != "no_internal_filenames":
        return F.lit("malformed")
    name = name.strip()
    if name in ("min_length", "max_length", "max_length_prose", "max_sentence_words") and not value.strip().lstrip("+-").isdigit():
        return F.lit("not a number")
    first = F.coalesce(F.get(F.filter(F.split(text, "\n"), lambda x: T.stripped(x) != ""), F.lit(0)), F.lit(""))
    prose = F.array_join(F.filter(F.split(T.without_citations(text), "\n"), lambda x: ~F.ltrim(x).rlike("^[|#>]")), " ")
    longest = lambda: F.array_max(F.transform(F.split(prose, r"(?<=[.!?])\s+"), T.word_count))
    checks = {
        "min_length": lambda: F.length(text) < int(value),
        "max_length": lambda: F.length(text) > int(value),
        "max_length_prose": lambda: F.length(T.without_citations(text)) > int(value),
        "max_sentence_words": lambda: longest() > int(value),
        "startswith": lambda: ~F.startswith(first, F.lit(value)),
        "contains": lambda: ~F.contains(text, F.lit(value)),
        "regex": lambda: ~text.rlike(f"(?m){value}"),
        "not_regex": lambda: text.rlike(f"(?m){value}"),
        "no_internal_filenames": lambda: F.size(internal_names(text)) > 0,
    }
    return F.when(checks[name](), "failed") if name in checks else F.lit("unknown rule")


def rule_strings(drafts: DataFrame, rules: list[str]) -> DataFrame:
    """id, place, problem of every rule that a draft (id, body) doesn't pass, in the rules' order; a null body is empty.

    Rules are a configured list: they are part of the plan, without a join. Those that compare with a baseline are
    gates.over_budget.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    marks = F.array(*[F.struct(F.lit(i).alias("place"), _rule(body, r).alias("problem")) for i, r in enumerate(rules)])
    return drafts.select("id", F.inline(F.filter(marks, lambda m: m["problem"].isNotNull())))


def targets() -> list[Column]:
    """Price targets as shown: two decimals, and the direction of the mean's upside with its arrow."""
    up = F.col("upside_pct_mean")
    shown = [F.format_string("%.2f", c).alias(c) for c in ("mean", "high", "low", "current")]
    direction = F.when(up > 0, "pos").when(up < 0, "neg").otherwise("flat")
    arrow = F.when(up > 0, "▲").when(up < 0, "▼").when(up == 0, "→").otherwise("")
    return [*shown, direction.alias("upside_direction"), arrow.alias("upside_arrow")]


def earnings_label(day: Column) -> Column:
    """A date as 04 Aug; a text that isn't a date stays."""
    return F.coalesce(F.date_format(day.try_cast("date"), "dd MMM"), day)


def price_frame(weeks: DataFrame, shown: int = WEEKS) -> DataFrame:
    """symbol, week, close, ma13, ma52 of the last `shown` weeks (symbol, week, close): means are taken before the cut."""
    def mean(n: int) -> Column:
        w = Window.partitionBy("symbol").orderBy("week").rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(w) == n, F.round(F.avg("close").over(w), 4))

    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("week")))
    rows = weeks.select("symbol", "week", "close", mean(13).alias("ma13"), mean(52).alias("ma52"), last.alias("_n"))
    return rows.where(F.col("_n") <= shown).drop("_n")


def benchmark_weeks(weeks: DataFrame, benchmark: str) -> DataFrame:
    """symbol, week, close, other: with the benchmark's close of the same week, for symbols with two such weeks or more."""
    other = weeks.where(F.col("symbol") == benchmark).select("week", F.col("close").alias("other"))
    both = weeks.where(F.col("symbol") != benchmark).join(other, "week")
    common = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return both.withColumn("_c", common).where("_c > 1").select("symbol", "week", "close", "other")


def bands(cards: DataFrame) -> DataFrame:
    """symbol, band, low, high, inside: the valuation bands of cards (symbol, fair, target_low, target_high, year_low,
    year_high, eps, peer_low, peer_high), and whether the fair value is in them.

    A band needs both ends, one above the other; peers' multiples need positive earnings; a card without a fair value
    has none.
    """
    c = F.col
    eps = F.when(c("eps") > 0, c("eps"))
    each = F.array(
        F.struct(F.lit("Analyst targets").alias("band"), c("target_low").alias("low"), c("target_high").alias("high")),
        F.struct(F.lit("52-week range").alias("band"), c("year_low").alias("low"), c("year_high").alias("high")),
        F.struct(F.lit("Peer multiple").alias("band"), (c("peer_low") * eps).alias("low"), (c("peer_high") * eps).alias("high")),
    )
    rows = cards.where(F.coalesce("fair", F.lit(0.0)) != 0).select("symbol", "fair", F.inline(each)).where("high > low")
    return rows.select("symbol", "band", "low", "high", F.col("fair").between(F.col("low"), F.col("high")).alias("inside"))


def newest_points(points: DataFrame, today: str, years: int = 10) -> DataFrame:
    """series, date, value, n of the newest of each series' points (series, date, value as text) in the last `years`.

    A point without a full date or a number (".") isn't one.
    """
    number = F.col("value").try_cast("double")
    since = F.add_months(F.lit(today).cast("date"), -12 * years).cast("string")
    sound = points.withColumn("value", number).where((F.length("date") >= 10) & F.col("value").isNotNull() & ~F.isnan("value")).withColumn("date", F.substring("date", 1, 10))
    newest = F.max(F.struct("date", "value")).alias("m")
    return sound.where(F.col("date") >= since).groupBy("series").agg(newest, F.count(F.lit(1)).alias("n")).select("series", "m.date", "m.value", "n")
