"""The pipeline's stages on the small tables, each against its operator's brute force or definition."""


def test_stages(spark):
    import corpus_pipeline as P
    from tarnbeck.llm.common import Scratch
    from tests.llm.test_operators import brute_near

    sf = "/root/testdata/sf0.01"
    docs, scratch, seen = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark), []
    for name, stage in P.STAGES:
        out = scratch.keep(stage(spark, docs, sf), "t")
        seen.append((docs, out))
        docs = out
    for before, after in seen[:4]:
        assert after.columns == before.columns
    quality, lines, near, leaks, packed = seen
    assert lines[0].count() == lines[1].count()
    rows = [(r.doc_id, r.text) for r in near[0].collect()]
    assert sorted(r.doc_id for r in near[1].collect()) == sorted(i for i, _, _, kept in brute_near(rows) if kept)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = " ".join(" ".join(r.text.split()) for r in leaks[1].collect()).lower()
    assert not any(" ".join(i.split()).lower() in clean for i in items)
    assert {r.doc_id for r in packed[1].collect()} == {r.doc_id for r in leaks[1].collect()}


def test_lines_stage_removes_short_repeats(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "Read more\n\nHome\nfour short words here"), (2, "Read more\n\nbody\nmore Read\nHome\nfour short words there")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.lines_stage(spark, docs, "").collect()}
    assert got == {1: "Read more\n\nHome\nfour short words here", 2: "\nbody\nfour short words there"}


def test_written_tables_let_the_driver_collect_its_garbage(spark):
    from tarnbeck.llm import common

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before, scratch = full(), common.Scratch(spark)
    for _ in range(2 * common.COLLECT):
        scratch.keep(spark.range(3), "t")
    assert full() - before >= 2


def test_components_are_reckoned_anew_for_new_links_alone(spark, monkeypatch):
    from tarnbeck.llm import near_dups

    calls, real = [], near_dups.components
    monkeypatch.setattr(near_dups, "components", lambda *a: calls.append(1) or real(*a))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, " ".join(f"v{i}" for i in range(60)))]
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1), (3, 3)]
    assert len(calls) == 1


def test_a_packing_worker_remembers_few_parts():
    from tarnbeck.llm import packing
    from tarnbeck.llm.queries import tokenizer
    from tests.llm.test_records import expected

    machine = packing.BlockTokens(tokenizer("word_bpe_49k.json"))
    for k in range(3):
        machine.block([" ".join(f"{chr(97 + k)}{i}" for i in range(100_000))])
    assert 100_000 < len(machine.place) <= 250_000
    ids, counts = machine.block(["a1 b2", "c99999"])
    assert counts.tolist() == [n - 1 for _, _, n, _ in expected([(1, "a1 b2"), (2, "c99999")])]
