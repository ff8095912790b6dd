"""Provenance: citation resolution, lineage, staleness, supersession and invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.functions.shared import written

# Microseconds of a minute and a day; the moment of what has no stamp, before all others.
MINUTE, DAY = 60_000_000, 86_400_000_000
NEVER = -(2**62)


def cited(pages: DataFrame) -> DataFrame:
    """id, cid of every page and citation."""
    return pages.select("id", F.explode(T.citations(F.col("body"))).alias("cid"))


def resolve(citations: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """cid's layer from the own artifacts (artifact, layer) or else the shared ones; missing if in neither."""
    a = own.select(F.col("artifact").alias("cid"), F.col("layer").alias("_own"))
    b = shared.select(F.col("artifact").alias("cid"), F.col("layer").alias("_shared"))
    return citations.join(a, "cid", "left").join(b, "cid", "left").select(*citations.columns, F.coalesce("_own", "_shared", F.lit("missing")).alias("layer"))


def unresolved(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References (carrier, ref) to no artifact, each once."""
    return refs.distinct().join(artifacts.select(F.col("artifact").alias("ref")), "ref", "left_anti").select("carrier", "ref")


def lineage(edges: DataFrame, depth: int = 3) -> DataFrame:
    """root, node, depth: what each node is derived from (edges node -> source), to a depth, each node once, cycles cut."""
    step = edges.select(F.col("node").alias("root"), F.col("source").alias("node"), F.lit(1).cast("long").alias("depth")).where("root <> node").distinct()
    out = step
    for d in range(2, depth + 1):
        step = step.select("root", F.col("node").alias("at")).join(edges.select(F.col("node").alias("at"), F.col("source").alias("node")), "at").where("root <> node").select("root", "node", F.lit(d).cast("long").alias("depth")).distinct()
        out = out.unionByName(step)
    return out.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def stale(now: Column, age_limit_days: Column, fetched: Column, on_earnings: Column, last_earnings: Column, missing: Column) -> Column:
    """Policy staleness: a missing artifact; older than its days; fetched before known earnings; else a week."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(fetched)) / 86400
    day = F.to_date(fetched)
    return (
        F.when(missing, True)
        .when(age_limit_days.isNotNull(), age > age_limit_days)
        .when(on_earnings & last_earnings.isNotNull(), (day < last_earnings) & (last_earnings <= F.to_date(now)))
        .otherwise(age > 7)
    )


def current(sources: DataFrame) -> DataFrame:
    """Sources that no other one supersedes."""
    return sources.join(sources.where("supersedes is not null").select(F.col("supersedes").alias("id")), "id", "left_anti")


def invalidated(answers: DataFrame, stamps: DataFrame, superseded: DataFrame) -> DataFrame:
    """qid, evidence: the first reference (ord) of each answer (qid, ord, id, stamp) that was replaced or has a newer stamp.

    Equal stamps are fresh; a reference without a stamp is stale by replacement alone.
    """
    now = answers.join(stamps.select("id", F.col("stamp").alias("now")), "id", "left").join(superseded.select("id", F.lit(True).alias("replaced")), "id", "left")
    bad = now.where(F.coalesce("replaced", F.lit(False)) | F.coalesce(F.col("now") > F.col("stamp"), F.lit(False)))
    return bad.groupBy("qid").agg(F.min_by("id", "ord").alias("evidence"))


def moment(stamp: Column, missing: int = NEVER) -> Column:
    """Microseconds of a stamp; `missing` without one."""
    return F.coalesce(F.unix_micros(stamp.cast("timestamp")), F.lit(missing))


def first_arrival(answered: DataFrame, arrivals: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """qid, evidence: the first (by ord, then id) arrival of a subscribed kind after the answer (or at any time if unanswered)."""
    asked = answered.select("qid", "section", moment(F.col("answered_at")).alias("at"))
    met = first_after(asked.select("section", "at").distinct(), arrivals, subscriptions)
    return asked.join(met, ["section", "at"]).groupBy("qid").agg(F.min("best").alias("best")).select("qid", F.col("best.id").alias("evidence"))


def first_after(moments: DataFrame, arrivals: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """section, at, best: of each moment (section, at; each once) the first arrival of a subscribed kind that comes later.

    Arrivals are read twice, for the least ord and for its least id, and go into groups before they are shuffled: those
    of a minute with a moment of their kind by instant, others of a day with one by minute, the rest by day. A moment
    looks at the later days of its kind, the later minutes of its day and the later instants of its minute. So no moment
    meets single arrivals, the groups are bounded by the moments' days and minutes where these are few, and by the
    arrivals' instants in any case. An arrival without an ord comes last, its evidence is null.
    """
    wanted = written(moments.join(subscriptions.distinct(), "section").select("section", "kind", "at").distinct(), "moments")
    cuts = wanted.select("kind", "at").distinct().withColumn("minute", F.expr(f"at div {MINUTE}")).withColumn("day", F.expr(f"at div {DAY}"))
    own_day = cuts.select("kind", "day", F.lit(True).alias("own_day")).distinct()
    own_minute = cuts.select("kind", "minute", F.lit(True).alias("own_minute")).distinct()
    came = arrivals.where("kind IS NOT NULL").select("kind", moment(F.col("stamp"), NEVER + 1).alias("at"), "ord", "id")
    came = came.withColumn("minute", F.expr(f"at div {MINUTE}")).withColumn("day", F.expr(f"at div {DAY}"))
    near = came.join(own_day, ["kind", "day"], "left").join(own_minute, ["kind", "minute"], "left")
    level = F.when(F.col("own_minute"), 2).when(F.col("own_day"), 1).otherwise(0)
    unit = F.when(F.col("own_minute"), F.col("at")).when(F.col("own_day"), F.col("minute")).otherwise(F.col("day"))
    key = ["kind", "level", "unit"]
    placed = near.select("kind", level.alias("level"), unit.alias("unit"), "ord", "id")
    least = written(placed.groupBy(*key).agg(F.min("ord").alias("ord")), "least")  # a struct's minimum would sort all rows
    ids = placed.join(least, [*key, "ord"]).groupBy(*key).agg(F.min("id").alias("id"))
    best = F.struct(F.isnull("ord").alias("last"), "ord", "id").alias("best")
    first = written(least.join(ids, key, "left").select(*key, best), "first")
    instants = first.where("level = 2").select("kind", F.expr(f"unit div {MINUTE}").alias("minute"), F.col("unit").alias("at"), "best")
    minutes = first.where("level > 0").select("kind", F.expr(f"CASE level WHEN 2 THEN unit div {MINUTE} ELSE unit END").alias("minute"), "best").withColumn("day", F.expr(f"minute div {DAY // MINUTE}"))
    days = first.select("kind", F.expr(f"CASE level WHEN 2 THEN unit div {DAY} WHEN 1 THEN unit div {DAY // MINUTE} ELSE unit END").alias("day"), "best")
    found = cuts.join(_later(cuts, days, ["kind"], "day"), ["kind", "day"]).join(_later(cuts, minutes, ["kind", "day"], "minute"), ["kind", "minute"]).join(_later(cuts, instants, ["kind", "minute"], "at"), ["kind", "at"])
    each = found.select("kind", "at", F.least("later_day", "later_minute", "later_at").alias("best")).where("best IS NOT NULL")
    return written(wanted.join(each, ["kind", "at"]).groupBy("section", "at").agg(F.min("best").alias("best")), "met")


def _later(cuts: DataFrame, rows: DataFrame, within: list[str], unit: str) -> DataFrame:
    """kind, unit, later_<unit>: the best of the later units within the same kind, day or minute."""
    none = F.lit(None).cast(rows.schema["best"].dataType).alias("best")
    each = cuts.select(*within, unit, none).union(rows.select(*within, unit, "best")).groupBy(*within, unit).agg(F.min("best").alias("best"))
    w = Window.partitionBy(*within).orderBy(F.desc(unit)).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*within, unit, F.min("best").over(w).alias(f"later_{unit}")).select("kind", unit, f"later_{unit}")


def ids_with_suffix(wanted: DataFrame) -> DataFrame:
    """Free ids: of rows that ask for the same stem, the second gets _2, the third _3 (by ord)."""
    n = F.row_number().over(Window.partitionBy("stem").orderBy("ord"))
    return wanted.select("stem", "ord", F.when(n == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), n)).alias("id"))
