from tarnbeck.operators import retrieval as R


def test_matches_equal_a_walk(spark, monkeypatch):
    """Terms in words, dots for any character, short runs between dots, repeated terms, empty and null texts; both ways to meet the words."""
    texts = ["The Apple-pie is. good\nx.ab y", "apple APPLE apples", "", None, "a&b axb zz", "xxab pineapple good"]
    docs = spark.createDataFrame([(f"d{i}", "2024", b) for i, b in enumerate(texts)] + [(None, "2024", "apple")], "id string, as_of string, body string")
    asked = {1: ["apple", "good", "apple"], 2: ["x.ab"], 3: ["a.b"], 4: [], 5: ["nothing"]}
    questions = spark.createDataFrame(list(asked.items()), "qid long, terms array<string>")

    def held(term, body):
        import re

        return any(re.search(term, w) for w in (body or "").lower().split())

    want = {(q, len(set(ts)), f"d{i}", sum(held(x, b) for x in set(ts))) for q, ts in asked.items() for i, b in enumerate(texts) if any(held(x, b) for x in ts)}
    for sent in (R.SENT, 0):
        monkeypatch.setattr(R, "SENT", sent)
        got = [(r.qid, r.n, r.id, r.matched) for r in R.matches_per_question(docs, questions).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    best = R.ranked_per_question(docs, questions.where("qid = 1"), 2).collect()
    assert sorted((r["rank"], r.id) for r in best) == [(1, "d0"), (2, "d5")]


def test_holders(spark):
    docs = spark.createDataFrame([("a", "1", "say: Red fox runs"), ("b", "1", "fox red runs"), ("c", "1", "Red fox runsome")], "id string, as_of string, body string")
    items = spark.createDataFrame([(1, "Red fox runs")], "qid long, item string")
    matches = R.matches_per_question(docs, spark.createDataFrame([(1, ["red", "fox", "runs"])], "qid long, terms array<string>"))
    assert sorted(r.id for r in R.holders(matches, docs, items).collect()) == ["a", "c"]
