"""First arrivals after an answer against every pair of both, and the rows that their joins make."""

import datetime
import random

import pytest

from tarnbeck.operators.provenance import first_arrival

ASKED, CAME, SUBS = "qid long, section string, answered_at timestamp", "kind string, stamp timestamp, ord long, id long", "section string, kind string"


def walk(asked, came, subs):
    out = {}
    for q, section, since in asked:
        kinds = {k for s, k in subs if s == section and k is not None and section is not None}
        met = [(o is None, o or 0, i) for k, stamp, o, i in came if k in kinds and (since is None or (stamp is not None and stamp > since))]
        if met:
            out[q] = min([*met, *([out[q]] if q in out else [])])
    return {q: None if last else i for q, (last, _, i) in out.items()}


def frames(spark, case):
    return [spark.createDataFrame(r, s) for r, s in zip(case, (ASKED, CAME, SUBS))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rnd = random.Random(seed)
    base = [datetime.datetime(1969, 12, 31, 23, 59, 59, 999990), datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 59, 999999), datetime.datetime(2024, 1, 2, 12)]
    steps = [datetime.timedelta(microseconds=m) for m in (0, 0, 1, 2, 10, 1_000, 60_000_000, 3_600_000_000, 90_000_000_000)]
    at = lambda: None if rnd.random() < 0.1 else rnd.choice(base) + rnd.choice(steps)
    asked = [(q, rnd.choice([None, "x", "y", "z"]), at()) for q in range(60)]
    came = [(rnd.choice([None, "a", "b", "c", "d"]), at(), rnd.choice([None, *range(40)]), i) for i in range(100)]
    case = asked + asked[:5] + [(0, "y", at())], came + [("e", at(), None, 1)], [("x", "a"), ("x", "a"), ("y", "b"), ("y", "c"), ("z", None), ("w", "e")]
    case[0].append((99, "w", None))
    expected = walk(*case)
    assert len(expected) > 20 and 99 in expected and None in expected.values()
    got = [tuple(r) for r in first_arrival(*frames(spark, case)).select("qid", "evidence").collect()]
    assert dict(got) == expected and len(got) == len(expected)


def nodes(plan):
    """All nodes of an executed plan, through the adaptive ones and the stages they have run."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    yield plan
    for p in inner:
        yield from nodes(p)


def test_questions_do_not_meet_single_arrivals(spark):
    day, n = datetime.datetime(2024, 1, 1), 300
    asked = [(q, "x", day + datetime.timedelta(seconds=q)) for q in range(n)]
    came = [("a", day + datetime.timedelta(seconds=i, milliseconds=500), n - i, i) for i in range(n)]
    out = first_arrival(*frames(spark, (asked, came, [("x", "a")])))
    assert sorted((r.qid, r.evidence) for r in out.collect()) == [(q, n - 1) for q in range(n)]
    plan = out._jdf.queryExecution().executedPlan()
    made = [p.metrics().apply("numOutputRows").value() for p in nodes(plan) if "Join" in p.nodeName() and p.metrics().contains("numOutputRows")]
    assert made and 0 < max(made) <= 2 * n  # not n * n / 2
