import io
from contextlib import redirect_stdout

import pytest

from tarnbeck.sources.evidence import SOURCE_KEYS, mapping, read_evidence, write_evidence

HEAD = "".join(f"{k}: {k} value\n" for k in SOURCE_KEYS if k not in ("kind", "title"))


def corpus(spark, path, rows):
    write_evidence(spark.createDataFrame(rows, "folder string, below string, name string, content string"), str(path))
    return str(path)


def test_front_matter_forms():
    text = "id: 'it''s'\ntitle: \"a: \\\"b\\\"\"\nlong: one\n  two\nlist:\n- x\n- 'y'\nrequest:\n  a: 1\n  b:\n    c: d\nnone:\nflag: true # yes\nflow: [a, b]\n"
    assert mapping(text.splitlines()) == {"id": "it's", "title": 'a: "b"', "long": "one two", "list": ["x", "y"], "request": {"a": "1", "b": {"c": "d"}}, "none": None, "flag": True, "flow": ["a", "b"]}


def test_sources(spark, tmp_path):
    whole = f"---\n{HEAD}kind: news\ntitle: T\ncited_urls:\n- u1\n- u2\n---\n\nBody\n---\nmore\n\n"
    long = f"---\n{HEAD}kind: web_page\ntitle: '{'x' * 40000}'\ntruncated: true\n---\n" + "word " * 50000
    at = corpus(spark, tmp_path / "c", [("A", "sources", "a.md", whole), ("A", "sources", "b.md", long), ("B", "sources", "a.md", whole), ("B", "notes", "c.md", whole), ("B", "sources", "d.txt", "x")])
    got = {(r.folder, r.file): r for r in read_evidence(spark, at).collect()}
    assert sorted(got) == [("A", "a"), ("A", "b"), ("B", "a")]
    assert got["A", "a"].body == "Body\n---\nmore" and got["A", "a"].cited_urls == ["u1", "u2"] and got["A", "a"].request is None and not got["A", "a"].truncated
    assert got["A", "b"].truncated and len(got["A", "b"].title) == 40000 and got["A", "b"].body == ("word " * 50000).strip() and got["A", "b"].cited_urls == []
    few = read_evidence(spark, at, columns=["file", "kind"])
    assert few.columns == ["file", "kind"] and sorted(map(tuple, few.collect())) == [("a", "news"), ("a", "news"), ("b", "web_page")]


def test_filters_reach_the_files(spark, tmp_path):
    """A folder, a name or a kind that is filtered out isn't parsed: its broken file raises nothing."""
    good = f"---\n{HEAD}kind: news\ntitle: T\n---\nBody"
    at = corpus(spark, tmp_path / "c", [("A", "sources", "a.md", good), ("A", "sources", "bad.md", "no matter"), ("B", "sources", "bad.md", "---\nid: x\n---\n")])
    rows = read_evidence(spark, at)
    kept = rows.where("folder = 'A' and file in ('a', 'z') and kind is not null and length(title) = 1")
    assert kept.count() == 1 and rows.where("folder = 'A' and file = 'a' and kind = 'other'").count() == 0
    shown = io.StringIO()
    with redirect_stdout(shown):
        kept.explain("formatted")
    assert "PushedFilters: [" in shown.getvalue() and "EqualTo(folder,A)" in shown.getvalue().replace(" ", "")
    with pytest.raises(Exception, match="bad.md: missing required key 'ticker'"):
        rows.where("folder = 'B'").collect()
    with pytest.raises(Exception, match="bad.md: missing required key 'id'"):
        rows.where("folder = 'A'").collect()
    soft = read_evidence(spark, at, mode="permissive").where("problem is not null").select("folder", "problem").collect()
    assert sorted(map(tuple, soft)) == [("A", "missing required key 'id'"), ("B", "missing required key 'ticker'")]


def test_artifacts(spark, tmp_path):
    meta = '{"id": "i", "ticker": "A", "producer": "fetch", "title": "T", "source": "s", "as_of": "d", "request": {"q": [1]}, "derived_from": ["x"]}'
    files = {"ok": f'{{"_meta": {meta}, "data": {{"v": "é"}}}}', "list": f'{{"_meta": {meta}, "data": [1]}}', "nodata": f'{{"_meta": {meta}}}', "nometa": '{"data": {}}', "cut": '{"_meta": ', "array": "[1]", "empty": "", "short": '{"_meta": {"id": "i"}, "data": {}}'}
    at = corpus(spark, tmp_path / "c", [("A", "structured", f"{k}.json", v) for k, v in files.items()])
    rows = {r.file: r for r in read_evidence(spark, at, "structured", mode="permissive").collect()}
    assert {k: r.problem for k, r in rows.items()} == {
        "ok": None, "list": None, "nodata": "missing required key 'data'", "nometa": "missing required key '_meta'", "cut": "invalid JSON", "array": "missing required key '_meta'", "empty": "invalid JSON", "short": "missing required key 'ticker'",
    }
    assert rows["ok"].data == '{"v":"é"}' and rows["ok"].request == '{"q":[1]}' and rows["ok"].derived_from == ["x"] and rows["list"].data == "[1]" and rows["ok"].adjusted is None
    total = {r.file: (r.meta is not None, r.data) for r in read_evidence(spark, at, "artifacts").collect()}
    assert total == {"ok": (True, '{"v":"é"}'), "list": (True, None), "nodata": (True, None), "nometa": (False, "{}"), "cut": (False, None), "array": (False, None), "empty": (False, None), "short": (True, "{}")}
    with pytest.raises(Exception, match="malformed file .*: (missing|invalid)"):
        read_evidence(spark, at, "structured").collect()


def test_names_stay_below_the_root(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert read_evidence(spark, str(tmp_path / "e")).count() == 0
    for folder, name in (("..", "a.md"), ("A", "../a.md"), ("A", "")):
        with pytest.raises(Exception, match="can't be a part of a path"):
            corpus(spark, tmp_path / "c", [(folder, "sources", name, "x")])
