"""Each check with a planted fault and a clean case."""

import json

from tarnbeck.operators.validation import has_errors, validate

META = {"id": "p", "ticker": "ABC", "title": "t", "source": "s", "url": "u", "fetched_at": "2024", "as_of": "2024", "provider_tool": "x", "fetch_cmd": "get", "computed_at": "2024", "generated_at": "2024"}


def artifact(producer, drop=(), data=1, **more):
    meta = {k: v for k, v in META.items() if k not in drop} | {"producer": producer, "derived_from": ["n1"]} | more
    return json.dumps({"_meta": meta, "data": data})


SOURCE = "---\nkind: news\nfetch_cmd: get it\n---\n"
CLEAN = {
    "sources/n1.md": SOURCE + "Body.", "sources/00_manifest.md": "no front matter", "structured/f1.json": artifact("fetch"), "derived/m1.json": artifact("model", ("url", "fetch_cmd")), "derived/a.urls.json": "{}", "derived/peers_user.json": "[]",
    "derived/c1.json": artifact("compute", ("url",)), "wiki/w.md": "---\nbuilt_from:\n- id: n1\n  fetched_at: x\n- 'c1'\n- shared1\n---\nSee [^n1] and [^shared1].", "reports/r/sections/valuation.md": "Plain [^f1].", "reports/r/sections/x.critique.md": "[^nowhere]",
    "reports/r/report.md": '<a href="#ref-1">1</a> ![a](a.png) ![b](b.png)', "reports/r/citation_map.json": '{"1": "n1"}', "reports/r/verdict.json": '{"scenario_probabilities": {"a": 0.5, "b": 0.5}, "fair_value": 100, "scenario_weighted_value": 101}', "note.txt": "token",
}
SHARED = [("_MACRO", "sources/shared1.md", "_MACRO/sources/shared1.md", SOURCE), ("_MACRO", "derived/silver1.json", "_MACRO/derived/silver1.json", artifact("compute", ("url",), derived_from=["shared1"]))]


def findings(spark, faults, ticker="ABC", resolved=None):
    files = [(ticker, p, (resolved or {}).get(p, f"{ticker}/{p}"), t) for p, t in (CLEAN | faults).items()] + SHARED
    df = spark.createDataFrame(files, "ticker string, path string, resolved string, text string").selectExpr("*", "1 AS id", "2 AS kind")
    out = validate(df)
    assert has_errors(out) == bool(out.collect())
    return sorted((r.check, r.path, r.code, r.detail) for r in out.collect())


def test_clean_corpus(spark):
    assert findings(spark, {}) == []


def test_one_fault_of_each_check(spark):
    long = "why " * 50
    planted = {
        "sources/out.md": SOURCE, "structured/bad.json": '{"_meta": {}}', "structured/torn.json": "{", "structured/m2.json": artifact("model", ("url",)), "structured/f2.json": artifact("fetch", ("title", "fetch_cmd")), "derived/c2.json": artifact("compute", (), derived_from=[]), "derived/x.json": artifact("scrape"),
        "sources/n2.md": "---\nkind: research_answer\n---\n", "sources/archive/n3.md": "---\nkind: blog\nfetch_cmd: x\n---\n", "wiki/w2.md": "[^gone] [^m1] [^silver1] [^gone]", "reports/q/report.md": '<a href="#ref-3">3</a>', "reports/s/report.md": '<a href="#ref-1">1</a><a href="#ref-2">2</a> [^n1] [^zz] ![a](a.png) ![b](a.png)',
        "reports/s/citation_map.json": '{"1": "m1"}', "reports/t/verdict.json": '{"scenario_probabilities": {"a": 0.5}}', "reports/t/sections/valuation.md": "A probability-weighted value.", "reports/u/verdict.json": json.dumps({"fair_value": 100, "scenario_weighted_value": 150.5, "reconciliation": long}), "reports/v/verdict.json": "[", "reports/w/verdict.json": "[1]", "reports/x/verdict.json": '{"scenario_weighted_value": 5}',
        "wiki/w3.md": "---\nbuilt_from:\n- id: lost\n  fetched_at: x\n---\n", "derived/c3.json": artifact("compute", ("url",), derived_from=["n1", "lost2"]), "derived/k.json": artifact("compute", ("url",), request={"params": [["token", {"a": 1}]]}), "sources/n4.md": '---\nkind: news\nfetch_cmd: x\nrequest: {"Token": ""}\n---\nsk-' + "a1" * 12,
    }
    got = findings(spark, planted, resolved={"sources/out.md": "/elsewhere/out.md"})
    secret = [g for g in got if g[0] == 10]
    assert len(secret) == 1 and secret[0][1:3] == ("sources/n4.md", "secret")
    assert [g for g in got if g[0] != 10] == sorted([
        (1, "sources/out.md", "path-containment", "outside the folder"), (2, "structured/bad.json", "producer-shape", "no _meta or data"), (2, "structured/torn.json", "producer-shape", "no _meta or data"),
        (2, "structured/m2.json", "layer-boundary", "model output under structured"), (2, "structured/m2.json", "producer-shape", "model with fetch_cmd"), (2, "structured/m2.json", "fetch-cmd", "model with fetch_cmd"),
        (2, "structured/f2.json", "producer-shape", "fetch without title"), (2, "structured/f2.json", "producer-shape", "fetch without fetch_cmd"), (2, "structured/f2.json", "fetch-cmd", "bronze without fetch_cmd"),
        (2, "derived/c2.json", "producer-shape", "compute with url"), (2, "derived/c2.json", "producer-shape", "compute without derived_from"), (2, "derived/x.json", "producer-shape", "unknown producer"),
        (3, "sources/n2.md", "layer-boundary", "model kind"), (3, "sources/n2.md", "fetch-cmd", "source without fetch_cmd"), (3, "sources/archive/n3.md", "layer-boundary", "unknown kind"),
        (4, "wiki/w2.md", "citation-unresolved", "missing: gone"), (4, "wiki/w2.md", "citation-unresolved", "silver: m1"), (4, "wiki/w2.md", "citation-unresolved", "silver: silver1"),
        (5, "reports/q/report.md", "citation-unresolved", "no citation_map.json"), (5, "reports/s/report.md", "citation-unresolved", "silver: 1"), (5, "reports/s/report.md", "citation-unresolved", "not in the map: 2"), (5, "reports/s/report.md", "citation-unresolved", "missing: zz"),
        (6, "reports/s/report.md", "exhibit-duplicated", "a.png"), (7, "reports/s/report.md", "citation-unlinked", "2 markers"),
        (8, "reports/t/verdict.json", "verdict-unreconciled", "probabilities don't add up to 1"), (8, "reports/t/verdict.json", "verdict-unreconciled", "weighted value only in the text"), (8, "reports/v/verdict.json", "verdict-unreconciled", "unreadable"), (8, "reports/w/verdict.json", "verdict-unreconciled", "no object"),
        (8, "reports/x/verdict.json", "verdict-unreconciled", "weighted value without fair value"), *[(8, "reports/u/verdict.json", "verdict-unreconciled", d) for d in ("reconciliation without fair_value", "reconciliation without scenario_weighted_value", "reconciliation not in the section")],
        (9, "wiki/w3.md", "derivation-unresolved", "missing: lost"), (9, "derived/c3.json", "derivation-unresolved", "missing: lost2"), (11, "derived/k.json", "secret", "names token"), (11, "sources/n4.md", "secret", "names Token"),
    ])


def test_names_of_tickers_and_nulls(spark):
    got = findings(spark, {"sources/n5.md": None}, ticker="abc")
    assert (1, "", "path-containment", "name of the ticker") in got
    assert [g for g in got if g[1] == "sources/n5.md"] == [(3, "sources/n5.md", "fetch-cmd", "source without fetch_cmd"), (3, "sources/n5.md", "layer-boundary", "unknown kind")]
    assert validate(spark.createDataFrame([], "ticker string, path string, resolved string, text string")).collect() == []
