"""Invalidation against one walk over questions, pages and derived entries in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tarnbeck.operators.invalidation import Invalidation, applied
from tests.test_arrivals import nodes


def walk(sources, artifacts, questions, subscriptions, pages, references):
    replaced, now = {s for _, s in sources if s is not None}, {}
    for i, _, _, stamp in artifacts:
        now[i] = max((x for x in (now.get(i), stamp) if x is not None), default=None)

    def stale(level, key):
        for _, i, stamp in sorted((r[2:] for r in references if r[:2] == (level, key)), key=lambda r: (r[0], -1 if r[1] is None else r[1])):
            if i in replaced or (stamp is not None and now.get(i) is not None and now[i] > stamp):
                yield i, i not in replaced

    def arrival(section, since):
        kinds = {k for s, k in subscriptions if s == section}
        some = [(o, i) for i, k, o, stamp in artifacts if k in kinds and k is not None and stamp is not None and (since is None or stamp > since)]
        return min(some)[1] if some else None

    reopened, revived, dirty, fresh = set(), set(), {}, {i for i, s in sources if s is not None}
    for h, section, status, answered, _ in questions:
        if status == "answered":
            found = next(stale("question", h), None)
            if found:
                reopened.add((h, section, "dependency", found[0]))
                fresh |= {found[0]} if found[1] else set()
                continue
        if status in ("answered", "deferred"):
            came = arrival(section, answered if status == "answered" else None)
            if came is not None:
                reopened |= {(h, section, "subscription", came)} if status == "answered" else set()
                revived |= {h} if status == "deferred" else set()
                fresh.add(came)
    for p, section, _ in pages:
        found = next(stale("page", p), None)
        if found:
            dirty[p] = section, found[0]
            fresh |= {found[0]} if found[1] else set()
    for key in {r[1] for r in references if r[0] == "derived"}:
        fresh |= {i for i, newer in stale("derived", key) if newer}
    return reopened, revived, {(p, *v) for p, v in dirty.items()}, {s for s, _ in dirty.values() if s is not None}, fresh


def frames(spark, rows):
    schemas = ["id long, supersedes long", "id long, kind string, ord long, stamp timestamp", "hash long, section string, status string, answered_at timestamp, ord long", "section string, kind string", "page long, section string, ord long", "level string, key long, ord long, id long, stamp timestamp"]
    return [spark.createDataFrame(r, s).withColumn("other", F.lit(1)) for r, s in zip(rows, schemas)]


def random_case(seed):
    import datetime

    rnd = random.Random(seed)
    at = lambda: rnd.choice([None, *(datetime.datetime(2024, 1, d, h) for d in (1, 2, 3) for h in (0, 9))])
    sources = [(i, rnd.choice([None, None, None, i - 100])) for i in range(100, 120)]
    artifacts = [(i, rnd.choice([None, "a", "b", "c"]), i, at()) for i in range(40)]
    questions = [(h, rnd.choice([None, "x", "y", "z"]), rnd.choice(["answered", "answered", "deferred", "open", "dropped"]), at(), h) for h in range(80)]
    subscriptions = [("x", "a"), ("x", "a"), ("y", "b"), ("y", "c"), ("z", None)]
    pages = [(p, rnd.choice([None, "x", "y", "z"]), p) for p in range(30)]
    references = [(level, rnd.randrange(n), k, rnd.choice([None, *range(45)]), at()) for level, n in (("question", 80), ("page", 30), ("derived", 5)) for k in range(60)]
    return sources, artifacts, questions, subscriptions, pages, references + references[:3]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_outputs(spark, seed):
    case = random_case(seed)
    plan = Invalidation(*frames(spark, case))
    reopened, revived, dirty, sections, fresh = walk(*case)
    assert reopened and revived and dirty and sections and {c for _, _, c, _ in reopened} == {"dependency", "subscription"}
    assert set(map(tuple, plan.reopened().collect())) == reopened
    assert {r.hash for r in plan.revived().collect()} == revived
    assert {(r.page, r.section, r.evidence) for r in plan.dirty_pages().collect()} == dirty
    assert {r.section for r in plan.dirty_sections().collect()} == sections
    assert {r.id for r in plan.new_evidence().collect()} == fresh
    counts = {r["output"]: r["count"] for r in plan.report().groupBy("output").count().collect()}
    assert counts == {"reopened": len(reopened), "revived": len(revived), "dirty page": len(dirty), "dirty section": len(sections), "new evidence": len(fresh)}


def test_applying_twice_changes_nothing_more(spark):
    case = random_case(4)
    inputs = frames(spark, case)
    once = applied(inputs[2], Invalidation(*inputs))
    again = inputs[2].drop("status").join(once, "hash")
    inputs[2] = again
    twice = applied(again, Invalidation(*inputs))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_equal_stamps_are_fresh_and_empty_tables_give_nothing(spark):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    case = ([(1, None)], [(7, "a", 0, day)], [(1, "x", "answered", day, 0)], [("x", "a")], [(1, "x", 0)], [("question", 1, 0, 7, day), ("page", 1, 0, 7, day)])
    assert Invalidation(*frames(spark, case)).report().collect() == []
    assert Invalidation(*frames(spark, [[]] * 6)).report().collect() == []


def test_questions_of_a_day_do_not_meet_its_artifacts_one_by_one(spark):
    import datetime

    day, n = datetime.datetime(2024, 1, 1), 300
    questions = [(q, "x", "answered", day + datetime.timedelta(seconds=q), q) for q in range(n)]
    artifacts = [(i, "a", n - i, day + datetime.timedelta(seconds=i, milliseconds=500)) for i in range(n)]
    causes = Invalidation(*frames(spark, ([], artifacts, questions, [("x", "a")], [], []))).causes()
    assert {(r.hash, r.evidence) for r in causes.collect()} == {(q, n - 1) for q in range(n)}
    made = [p.metrics().apply("numOutputRows").value() for p in nodes(causes._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName() and p.metrics().contains("numOutputRows")]
    assert made and 0 < max(made) <= 2 * n  # not n * n / 2


def test_rows_of_one_hash_are_one_question(spark):
    import datetime

    day = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    questions = [(1, "x", "answered", day[1], 0), (1, "y", "answered", day[0], 0)]
    case = ([], [(7, "a", 1, day[2]), (8, "b", 0, day[1])], questions, [("x", "a"), ("y", "b")], [], [])
    assert {(r.hash, r.section, r.evidence) for r in Invalidation(*frames(spark, case)).reopened().collect()} == {(1, "x", 8), (1, "y", 8)}
