"""Closing questions of the ledger: answered against bronze evidence, or dropped.

An answer (qhash, ord, sources, artifacts, at) closes its question only if it names sources and every one of them is
bronze, among the ticker's own artifacts first, then the shared ones; else nothing of it is taken. Answers to one question
are taken in their order: sources and artifacts are added to those that are there, each id once, with the stamp of its
first taking, and the last answer's time stands. Artifacts are a trail and aren't looked up.

A source that very many answers name meets them in a join with one row on its side; an answer's problems are gathered by
partial aggregation. The lists of one question are held together, as the ledger itself does.

Cases: an unknown question, no sources and an own silver artifact (even where a shared bronze one has its id) refuse the
answer. Null ids among the sources are missing ones. Repeated rows of one answer count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(ledger: DataFrame, answers: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """qhash, ord, at, artifacts, stamps (pos, id, stamp), problem (null: taken) of every answer."""
    asked = answers.dropDuplicates(["qhash", "ord"])
    mine = own.groupBy("id").agg(F.min("layer").alias("_layer"), F.max("stamp").alias("_stamp"))
    theirs = shared.where("layer = 'bronze'").groupBy("id").agg(F.max("stamp").alias("_shared_stamp"), F.lit(True).alias("_there"))
    named = asked.select("qhash", "ord", F.posexplode("sources").alias("pos", "id")).join(mine, "id", "left").join(theirs, "id", "left")
    layer = F.coalesce("_layer", F.when(F.col("_there"), "bronze"), F.lit("missing"))
    stamp = F.when(F.col("_layer").isNotNull(), F.col("_stamp")).otherwise(F.col("_shared_stamp"))
    bad = F.when(layer == "silver", F.concat(F.lit("silver: "), F.col("id").cast("string"))).when(layer == "missing", F.concat(F.lit("not found: "), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    looked = named.groupBy("qhash", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "id", stamp.alias("stamp")))).alias("stamps"), F.min_by(bad, F.when(bad.isNotNull(), F.col("pos"))).alias("bad"))
    known = ledger.select("qhash", F.lit(True).alias("_known")).distinct()
    every = asked.join(looked, ["qhash", "ord"], "left").join(known, "qhash", "left")
    problem = F.when(F.col("_known").isNull(), "unknown question").when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "no sources").otherwise(F.col("bad"))
    return every.select("qhash", "ord", "at", "artifacts", "stamps", problem.alias("problem"))


def refused(ledger: DataFrame, answers: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """qhash, ord, problem of the answers that leave their question as it is."""
    return judged(ledger, answers, own, shared).where("problem IS NOT NULL").select("qhash", "ord", "problem")


def _once(items, key):
    """The items whose key no earlier one has."""
    before = lambda i: F.transform(F.slice(items, F.lit(1), i), key)
    return F.filter(items, lambda x, i: ~F.coalesce(F.array_contains(before(i), key(x)), F.lit(False)))


def mark_answered(ledger: DataFrame, answers: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """The ledger (qhash, status, answered_at, sources: id and stamp, artifacts) after the answers."""
    taken = judged(ledger, answers, own, shared).where("problem IS NULL")
    stamps = F.transform("stamps", lambda s: F.struct(s["id"].alias("id"), s["stamp"].alias("stamp")))
    trail = F.coalesce("artifacts", F.array().cast("array<string>"))
    rows = F.array_sort(F.collect_list(F.struct("ord", F.col("at"), stamps.alias("stamps"), trail.alias("trail"))))
    new = taken.groupBy("qhash").agg(rows.alias("_new"))
    both = ledger.join(new, "qhash", "left")
    more = lambda field: F.flatten(F.transform("_new", lambda a: a[field]))
    sources = F.concat(F.coalesce("sources", F.array().cast("array<struct<id: bigint, stamp: timestamp>>")), more("stamps"))
    artifacts = F.concat(F.coalesce("artifacts", F.array().cast("array<string>")), more("trail"))
    done = F.col("_new").isNotNull()
    return both.select(
        "qhash", F.when(done, "answered").otherwise(F.col("status")).alias("status"), F.when(done, F.element_at("_new", -1)["at"]).otherwise(F.col("answered_at")).alias("answered_at"),
        F.when(done, _once(sources, lambda s: s["id"])).otherwise(F.col("sources")).alias("sources"), F.when(done, F.array_distinct(artifacts)).otherwise(F.col("artifacts")).alias("artifacts"))


def drop_questions(ledger: DataFrame, drops: DataFrame) -> DataFrame:
    """The ledger with the named questions (qhash) dropped, whatever their status."""
    gone = drops.select("qhash", F.lit("dropped").alias("_gone")).distinct()
    return ledger.join(gone, "qhash", "left").withColumn("status", F.coalesce("_gone", "status")).drop("_gone")
