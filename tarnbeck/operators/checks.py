"""Checks of verdict cards, budgets, addresses, runs and peer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators.addresses import address_kind  # noqa: F401
from tarnbeck.operators.findings import findings

# Limits of the checks.
MOST_AGENTS, MOST_TOKENS, MOST_MINUTES = 100, 6_000_000, 60
FRESH_DAYS, RECALL_DROP = 30, 0.02
CLAIM_WORDS, SUPPORT = 40, (3, 5)


def verdict_problems() -> dict[str, Column]:
    """Of a card's rating, price and probability: missing values count as problems of their own."""
    c = F.col
    return {
        "rating missing": c("rating").isNull(),
        "price missing": c("price").isNull(),
        "price not positive": c("price") <= 0,
        "probability missing": c("probability").isNull(),
        "probability out of range": ~c("probability").between(0, 1),
    }


def verdict_findings(cards: DataFrame, *keys: str) -> DataFrame:
    return findings(cards, list(keys), verdict_problems())


def incoherent(scenarios: DataFrame, key: str, slack: float = 0.01) -> DataFrame:
    """Cards whose scenario probabilities don't add up to one; a null counts as nothing."""
    total = F.round(F.sum(F.coalesce("probability", F.lit(0.0))), 6)
    return scenarios.groupBy(key).agg(total.alias("total")).where(F.abs(F.col("total") - 1) > slack)


def pillar_problems(claim: Column, support: Column) -> dict[str, Column]:
    """A claim has a number and forty words at most, its support three to five sentences."""
    sentences = F.size(F.regexp_extract_all(support, F.lit(r"([.!?])(?:\s|$)"), F.lit(1)))
    return {
        "claim without number": ~claim.rlike("[0-9]"),
        "claim too long": T.word_count(claim) > CLAIM_WORDS,
        "support length": ~sentences.between(*SUPPORT),
    }


def over_budget(runs: DataFrame, *keys: str) -> DataFrame:
    return findings(runs, list(keys), {"agents": F.col("agents") > MOST_AGENTS, "tokens": F.col("tokens") > MOST_TOKENS, "minutes": F.col("minutes") > MOST_MINUTES})


def fresh(fetched: Column, now: Column, days: int = FRESH_DAYS) -> Column:
    """At most `days` old; an unknown time is stale."""
    return F.coalesce(fetched >= now - F.make_dt_interval(F.lit(days)), F.lit(False))


def amendment(form: Column) -> Column:
    return F.endswith(form, F.lit("/A"))


def mostly_empty(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """Groups in which more than half of all cells are null."""
    empty = sum((F.col(c).isNull().cast("long") for c in columns[1:]), F.col(columns[0]).isNull().cast("long"))
    return table.groupBy(key).agg(F.sum(empty).alias("empty"), (F.count(F.lit(1)) * len(columns)).alias("cells")).where(F.col("empty") * 2 > F.col("cells"))


def regressed(result: Column, baseline: Column, tolerance: float = RECALL_DROP) -> Column:
    """Without a result or a baseline the gate fails too."""
    return F.coalesce(F.round(baseline - result, 9) > tolerance, F.lit(True))


def cost_by_purpose(logs: DataFrame, stats: DataFrame, order: list[str]) -> DataFrame:
    """place, purpose, agents, minutes, tokens: known purposes in their order, others by name; either side may lack one."""
    a = logs.groupBy("purpose").agg(F.sum("minutes").alias("minutes"))
    b = stats.groupBy("purpose").agg(F.count(F.lit(1)).alias("agents"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
    known = F.array(*[F.lit(o) for o in order])
    rows = a.join(b, "purpose", "full_outer")
    at = F.array_position(known, F.col("purpose"))
    place = F.row_number().over(Window.orderBy(at == 0, at, "purpose"))  # one row per purpose
    return rows.select(place.cast("long").alias("place"), "purpose", F.coalesce("agents", F.lit(0)).alias("agents"), F.coalesce("minutes", F.lit(0)).alias("minutes"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def run_order(name: Column) -> list[Column]:
    """Sort keys of runs `date` or `date_n`: by date, by number, by name."""
    return [F.substring(name, 1, 10), F.coalesce(F.regexp_extract(name, r"_(\d+)$", 1).try_cast("int"), F.lit(1)), name]


def current_run(runs: DataFrame, key: str) -> DataFrame:
    """The newest run without a snapshot per key; null where all have one."""
    open_run = F.when(~F.col("done"), F.struct(*run_order(F.col("run"))))
    return runs.groupBy(key).agg(F.max_by(F.when(~F.col("done"), F.col("run")), open_run).alias("run"))


def state_delta(shared: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """shared (key, value) with the values that changed between the two snapshots; what another writer changed stays."""
    old, new = before.select("key", F.col("value").alias("_old")), after.select("key", F.col("value").alias("_new"))
    changed = new.join(old, "key", "left").where(~F.col("_new").eqNullSafe(F.col("_old"))).select("key", "_new", F.lit(True).alias("_c"))
    return shared.join(changed, "key", "full_outer").select("key", F.when(F.col("_c"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, wave (from 0) of a dependency graph (node, needs); needs outside the nodes don't count. A cycle raises.

    The registry holds a dozen kinds, and more than LEVELS_MOST are refused: they are ordered on the driver.
    """
    names = [r[0] for r in nodes.select("node").distinct().limit(LEVELS_MOST + 1).collect()]
    if len(names) > LEVELS_MOST:
        raise ValueError(f"more than {LEVELS_MOST} kinds")
    kinds = F.array(*[F.lit(n) for n in names])
    inner = edges.where(F.array_contains(kinds, F.col("node")) & F.array_contains(kinds, F.col("needs"))).distinct()
    needs: dict[str, set[str]] = {n: set() for n in names}
    for r in inner.select("node", "needs").collect():  # LEVELS_MOST squared at most
        needs[r["node"]].add(r["needs"])
    wave: dict[str, int] = {}
    while len(wave) < len(names):
        ready = [n for n in names if n not in wave and needs[n] <= wave.keys()]
        if not ready:
            raise ValueError("the kinds depend on each other in a cycle")
        n_wave = max(wave.values(), default=-1) + 1
        wave |= dict.fromkeys(ready, n_wave)
    return nodes.sparkSession.createDataFrame(list(wave.items()), "node string, wave long")


LEVELS_MOST = 1000
