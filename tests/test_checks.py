"""Nulls, empty tables, ties and repeated rows of checks, harvests and versioned tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarnbeck.operators import checks as C
from tarnbeck.operators import harvest as H
from tarnbeck.operators import reports as R
from tarnbeck.operators import statements as S
from tarnbeck.sources.sinks import Versions


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.read() is None
    day = datetime.date
    assert v.upsert(spark.createDataFrame([("a", day(2024, 1, 1), 1), ("b", None, 2)], "id string, stamp date, x int"), "id", "stamp") == 1
    assert v.upsert(spark.createDataFrame([("a", day(2023, 1, 1), 3), ("b", None, 4), ("c", day(2024, 1, 1), 5)], "id string, stamp date, x int"), "id", "stamp") == 2
    assert sorted((r.id, r.x) for r in v.read().collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(r.id for r in v.read(1).collect()) == ["a", "b"]
    (tmp_path / "t" / "v00000003").mkdir()  # unfinished
    assert v.numbers() == [1, 2] and v.replace(v.read(1)) == 3


def test_addresses(spark):
    ips = [("::ffff:127.0.0.1", "loopback"), ("1.2.3", "invalid"), ("1.2.3.256", "invalid"), ("::1", "loopback"), ("::", "unspecified"), ("0:0:0:0:0:0:0:1", "loopback"), ("2606:4700::1111", "public"), ("fe80::1", "link_local"), ("zz::1", "invalid"), (None, "invalid"), ("", "invalid"), ("169.254.169.254", "metadata"), ("172.32.0.1", "public"), ("255.255.255.255", "reserved")]
    rows = spark.createDataFrame(ips, "ip string, want string").select("want", C.address_kind(F.col("ip")).alias("kind")).collect()
    assert all(r.want == r.kind for r in rows)


def test_levels(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "elsewhere"), ("a", "b")], "node string, needs string")
    assert {r.node: r.wave for r in C.levels(edges, nodes).collect()} == {"b": 0, "a": 1}
    with pytest.raises(ValueError):
        C.levels(edges.union(spark.createDataFrame([("b", "a")], "node string, needs string")), nodes)


def test_merged_spans_touch_and_empty(spark):
    hits = spark.createDataFrame([(1, 5, 100), (1, 5, 100), (1, 25, 100), (1, 99, 100), (2, 0, 0)], "id int, pos int, size int")
    assert sorted(map(tuple, R.merged_spans(hits, 10).collect())) == [(1, 0, 35), (1, 89, 100), (2, 0, 0)]
    assert R.merged_spans(hits.where("false"), 10).count() == 0


def test_plan_fetches_up_to_most(spark):
    urls = spark.createDataFrame([("q", i, f"u{i}") for i in range(5)], "answer string, ord int, url string")
    mapped = spark.createDataFrame([("q", "u0"), ("q", "u0")], "answer string, url string")
    pages = spark.createDataFrame([("u1", datetime.datetime(2024, 1, 1)), ("u2", None)], "url string, fetched timestamp")
    got = {r.url: r.action for r in H.plan(urls, mapped, pages, F.lit("2024-01-31").cast("timestamp"), 2).collect()}
    assert got == {"u0": "skip", "u1": "reuse", "u2": "fetch", "u3": "fetch", "u4": "left"}


def test_nulls(spark):
    one = spark.createDataFrame([(None, None, 0.0)], "a double, b double, zero double")
    r = one.select(C.regressed(F.col("a"), F.col("zero")).alias("regressed"), S.change(F.col("a"), F.col("zero")).alias("change"), S.diverges(F.col("a"), F.col("b")).alias("diverges"), S.implied_return(F.lit(1.0), F.col("zero")).alias("implied"), C.fresh(F.col("a").cast("timestamp"), F.current_timestamp()).alias("fresh")).first()
    assert (r.regressed, r.change, r.diverges, r.implied, r.fresh) == (True, None, False, None, False)


def test_longest_sentence_takes_the_first_of_equals(spark):
    docs = spark.createDataFrame([(1, "One two. Three four! | five"), (2, "# head\n> quote\n| a | b c d e f |"), (3, "")], "id int, body string")
    assert sorted(map(tuple, R.longest_sentence(docs).collect())) == [(1, 0, 2), (2, 0, 0), (3, 0, 0)]


def test_invalid_search_term_is_named():
    from tarnbeck.operators.retrieval import compiled

    assert compiled(["a.b", "^x$"]) == ["a.b", "^x$"]
    with pytest.raises(ValueError, match="invalid term"):
        compiled(["fine", "(open"])


def test_query_terms(spark):
    from pyspark.sql import functions as F

    from tarnbeck.functions import text as T
    from tarnbeck.plans.corpus import STOP

    rows = [("Is R&D up vs FY25?",), ("Margin margin MARGIN",), ("What is it about?",), ("The next-generation one",)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(T.query_terms(F.col("q"), STOP)).collect()]
    assert got == [["r&d", "fy25"], ["margin"], [], ["next-generation", "one"]]


def test_credential_names_at_any_depth(spark):
    from pyspark.sql import functions as F

    from tarnbeck.operators.gates import credential_names

    rows = [('{"a": [{"b": {"ApiKey": ""}}], "x": ["token", "v"]}',), ('{"monkey": 1, "key": "token"}',), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(credential_names(F.col("j"))).collect()]
    assert got == [["ApiKey", "token"], [], []]
