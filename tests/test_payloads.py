from tarnbeck.sources import payloads as R


def answers(spark, *texts):
    return spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "ticker string, payload string")


ODD = [None, "", "no JSON", "[]", "{}", "5", '{"price_targets": [1], "upgrades_downgrades": {"a": 1}, "earnings_dates": [1], "eps_trend": "x", "observations": 3, "data": []}']


def test_odd_answers_give_no_rows(spark):
    odd = answers(spark, *ODD)
    for made in (R.profiles, R.estimate_trends, R.price_targets, R.rating_actions, R.earnings_dates, R.published_series, R.articles, R.computed_multiples, R.newest_rows, R.peer_symbols):
        assert made(odd).collect() == [], made.__name__
    assert R.statement_items(odd, "income_stmt").collect() == []


def test_revisions_are_null_after_nothing_or_zero(spark):
    rows = R.estimate_trends(answers(spark, '{"eps_trend": {"0q": {"current": -3, "7daysAgo": -2, "30daysAgo": 0, "90daysAgo": 4}}}')).collect()
    assert [tuple(r) for r in rows] == [("t0", "current_quarter", -3.0, -50.0, None, None, -175.0)]


def test_rows_are_dated_by_the_field_of_the_first(spark):
    text = '{"data": {"short_interest": [{"date": "2024-01-01"}, {"date": null}, {"date": "2024-03-01", "filing_date": "2020-01-01"}], "insider_trading": [{"x": 1}, {"date": "2024-01-01"}], "major": [{"date": "2024-01-01"}]}}'
    rows = R.newest_rows(answers(spark, text), {"short_interest": 2, "insider_trading": 5})
    assert sorted((r.dataset, r.n, r.date) for r in rows.collect() if r.date) == [("short_interest", 1, "2024-03-01"), ("short_interest", 2, "2024-01-01")]
    assert rows.where("dataset = 'insider_trading'").count() == 2


def test_newest_actions_are_kept(spark):
    text = '{"upgrades_downgrades": [' + ", ".join(f'{{"date": "2024-01-{d:02d}", "Firm": "F{d}"}}' for d in range(1, 31)) + "]}"
    rows = sorted(R.rating_actions(answers(spark, text)).collect(), key=lambda r: r.n)
    assert len(rows) == 25 and rows[0].firm == "F30" and rows[-1].firm == "F6"


def test_articles_of_both_shapes(spark):
    text = '[{"content": {"title": "a", "canonicalUrl": {"url": "u"}}}, {"title": "b", "link": "v", "publisher": "p", "providerPublishTime": 0}, {"title": "c"}]'
    rows = sorted(R.articles(answers(spark, text)).collect(), key=lambda r: r.place)
    assert [tuple(r) for r in rows] == [("t0", 0, "a", "u", "", ""), ("t0", 1, "b", "v", "p", "1970-01-01T00:00:00+00:00")]
