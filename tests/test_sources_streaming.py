from tarnbeck.sources.readers import append_sources, artifacts, front_matter
from tarnbeck.streaming.freshness import newest, windowed_counts


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: x1\nkind: 'news'\n---\nBody\nmore\n")
    (tmp_path / "b.md").write_text("no matter")
    (tmp_path / "a.json").write_text('{"_meta": {"id": "p"}, "data": {"x": 1}}')
    (tmp_path / "b.json").write_text("{broken")
    got = front_matter(spark, str(tmp_path / "*.md"), ["id", "kind", "url"]).collect()
    assert [(r.id, r.kind, r.url, r.body) for r in got] == [("x1", "news", None, "Body\nmore\n")]
    assert sorted(r.ok for r in artifacts(spark, str(tmp_path / "*.json")).collect()) == [False, True]


def test_append_refuses_known_ids(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "a")], "id string, supersedes string")
    assert append_sources(rows, str(tmp_path / "s")) == 0
    assert append_sources(rows, str(tmp_path / "s")) == 2
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    for name, frame, mode in (("w", windowed_counts, "complete"), ("k", lambda e: newest(e, "user_id"), "complete")):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = frame(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == events.count()
    assert spark.table("k").count() == events.select("user_id").distinct().count()
