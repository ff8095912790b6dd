import datetime

from tarnbeck.operators import artifacts as A
from tarnbeck.sources import filings as R

ODD = [None, "", "no JSON", "[]", "{}", "5", '{"tenk": [1], "tenq": "x", "eightks": {"a": 1}}', '[{"date": null}, 3]']


def answers(spark, *texts):
    return spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "ticker string, payload string")


def test_odd_answers_give_no_rows(spark):
    odd = answers(spark, *ODD)
    assert R.filed(odd).collect() == [] and R.current_reports(odd, "2024-01-01").collect() == []
    assert R.latest_call(odd).collect() == [] and R.encyclopedia(odd).collect() == []


def test_first_of_equal_call_dates(spark):
    text = '[{"date": "2024-02-01", "fiscalYear": 2023, "quarter": 4}, {"date": "2024-02-01", "fiscalYear": 2022, "quarter": 1}]'
    assert [tuple(r) for r in R.latest_call(answers(spark, text)).collect()] == [("t0", "2024-02-01", 2023, 4)]


def test_a_long_enough_summary_is_looked_for_in_order(spark):
    text = '[{"title": "a", "summary": "short"}, {"title": "b", "summary": "%s", "content": "c"}, {"title": "d", "summary": "%s"}]' % ("x" * 100, "y" * 200)
    row = R.encyclopedia(answers(spark, text)).first()
    assert row.title == "b" and row.body == "## Summary\n\n" + "x" * 100 + "\n\n## Full article\n\nc"


def test_logs_without_matter_stay(spark):
    logs = spark.createDataFrame([("r", "02_b", "broken"), ("r", "01_a", None), ("r", "03_c", "---\nstarted_at: 2024\nround: 2\nlabel: 'x'\n---\nbody")], "run string, name string, text string")
    rows = sorted(R.task_logs(logs).collect(), key=lambda r: r.place)
    assert [(r.name, r.purpose, r.label, r["round"], r.status) for r in rows] == [("03_c", "unknown", "x", 2, "ok"), ("01_a", "unknown", "01_a", None, "ok"), ("02_b", "unknown", "02_b", None, "ok")]


def test_latest_run_goes_before_newer_ones(spark):
    runs = spark.createDataFrame([("t", "2024", None, '{"a": 1}'), ("t", "2023", True, '{"b": 1}'), ("t", "2025", None, "{x"), ("u", "1", None, "[]"), ("u", "0", False, None)], "ticker string, run string, latest boolean, payload string")
    assert [tuple(r) for r in R.latest_verdict(runs).collect()] == [("t", "2023", '{"b": 1}')]


def test_append_refuses_and_archives(spark):
    held = spark.createDataFrame([("a", "news", None), ("b", "news", datetime.date(2023, 1, 1)), ("c", "news", None)], "id string, kind string, archived_on date")
    new = spark.createDataFrame([("d", "news", "a", 1), ("d", "news", "c", 2), ("b", "news", None, 3), ("e", "research_answer", "c", 4), ("../f", "news", "c", 5), ("g", "news", "b", 6), ("h", None, None, 7), (None, "news", None, 8)], "id string, kind string, supersedes string, ord int")
    got = {r.id: r.archived_on for r in A.append_sources(held, new, "2024-01-01").collect()}
    assert got == {"a": datetime.date(2024, 1, 1), "b": datetime.date(2023, 1, 1), "c": None, "d": None, "g": None}
    none = A.append_sources(held.limit(0), new.limit(0), "2024-01-01")
    assert none.columns == ["id", "kind", "archived_on"] and none.collect() == []


def test_upsert_refuses_credentials(spark):
    held = spark.createDataFrame([("a", 2, "{}")], "id string, stamp int, request string")
    new = spark.createDataFrame([("a", 2, '{"n": 1}', "fetch"), ("b", 1, '{"q": {"token": "x"}}', "fetch"), ("c", 1, None, "model"), ("d", 1, "{}", None), ("e", 1, "{}", "compute")], "id string, stamp int, request string, producer string")
    assert sorted(tuple(r) for r in A.upsert(held, new).collect()) == [("a", 2, '{"n": 1}'), ("e", 1, "{}")]


def test_rules(spark):
    drafts = spark.createDataFrame([(1, "Title\n\nSee prices.json"), (2, None), (3, "x" * 50)], "id int, body string")
    rules = ["startswith: Title", "no_internal_filenames", "no_internal_filenames: ", "max_length: 40", "min_length: few", "contains", "wishful: 1", "regex: ^See"]
    got = {}
    for r in A.rule_strings(drafts, rules).collect():
        got.setdefault(r.id, []).append((r.place, r.problem))
    always = [(4, "not a number"), (5, "malformed"), (6, "unknown rule")]
    assert sorted(got[1]) == [(1, "failed"), (2, "failed"), *always]
    assert sorted(got[2]) == [(0, "failed"), *always, (7, "failed")]
    assert sorted(got[3]) == [(0, "failed"), (3, "failed"), *always, (7, "failed")]


def test_index_shows_missing_sections(spark):
    pages = spark.createDataFrame([("t", "profile", "a | b", None, 2, 0, None)], "ticker string, name string, summary string, updated string, sources int, questions int, dirty boolean")
    lines = [r.line for r in A.index_lines(pages, ["profile", "financial"]).orderBy("place").collect()]
    assert lines == ["| 1 | [profile](profile.md) | a \\| b |  | 2 | 0 |  |", "| 2 | financial | — | — | — | — | not written |"]
