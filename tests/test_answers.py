"""Closing questions: what is taken, what is refused, and what stays."""

import datetime

from tarnbeck.operators import answers as W

DAY = [datetime.datetime(2024, 1, d) for d in range(1, 9)]
LEDGER = [("q1", "open", None, [], []), ("q2", "reopened", DAY[0], [(1, DAY[0])], ["old"]), ("q3", "deferred", None, None, None), ("q4", "open", None, [], [])]
OWN = [(1, "bronze", DAY[1]), (2, "silver", DAY[1]), (3, "bronze", DAY[2]), (3, "bronze", DAY[3])]
SHARED = [(1, "bronze", DAY[7]), (2, "bronze", DAY[7]), (5, "bronze", DAY[7]), (6, "silver", DAY[7])]
ANSWERS = [
    ("q1", 1, [1, 5, 1], ["a"], DAY[4]), ("q1", 2, [3], None, DAY[5]), ("q1", 2, [3], None, DAY[5]), ("q1", 3, [1, 2], ["b"], DAY[6]),
    ("q2", 1, [1, 3], ["old", "new"], DAY[4]), ("q3", 1, [6], [], DAY[4]), ("q3", 2, [], [], DAY[4]), ("q3", 3, None, [], DAY[4]), ("q3", 4, [9], [], DAY[4]), ("q3", 5, [None], [], DAY[4]), ("q9", 1, [1], [], DAY[4]),
]


def frames(spark, answers=ANSWERS):
    return (
        spark.createDataFrame(LEDGER, "qhash string, status string, answered_at timestamp, sources array<struct<id: bigint, stamp: timestamp>>, artifacts array<string>"),
        spark.createDataFrame(answers, "qhash string, ord int, sources array<bigint>, artifacts array<string>, at timestamp"),
        spark.createDataFrame(OWN, "id long, layer string, stamp timestamp"), spark.createDataFrame(SHARED, "id long, layer string, stamp timestamp"),
    )


def test_answers(spark):
    got = {r.qhash: (r.status, r.answered_at, None if r.sources is None else [tuple(s) for s in r.sources], r.artifacts) for r in W.mark_answered(*frames(spark)).collect()}
    assert got == {
        "q1": ("answered", DAY[5], [(1, DAY[1]), (5, DAY[7]), (3, DAY[3])], ["a"]),
        "q2": ("answered", DAY[4], [(1, DAY[0]), (3, DAY[3])], ["old", "new"]),
        "q3": ("deferred", None, None, None), "q4": ("open", None, [], []),
    }


def test_refusals(spark):
    got = sorted((r.qhash, r.ord, r.problem) for r in W.refused(*frames(spark)).collect())
    assert got == [("q1", 3, "silver: 2"), ("q3", 1, "not found: 6"), ("q3", 2, "no sources"), ("q3", 3, "no sources"), ("q3", 4, "not found: 9"), ("q3", 5, "not found: "), ("q9", 1, "unknown question")]


def test_no_answers_and_drops(spark):
    ledger, none, own, shared = frames(spark, [])
    assert sorted(W.mark_answered(ledger, none, own, shared).collect(), key=lambda r: r.qhash) == sorted(ledger.collect(), key=lambda r: r.qhash)
    dropped = W.drop_questions(ledger, spark.createDataFrame([("q1",), ("q1",), ("q8",)], "qhash string"))
    assert {r.qhash: r.status for r in dropped.collect()} == {"q1": "dropped", "q2": "reopened", "q3": "deferred", "q4": "open"}
