"""The training-data operators against brute force, on small rows with the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import decontam, html_text, licenses, lines, near_dups, packing, pseudo_lm, quality, substrings, token_counts
from tarnbeck.llm.queries import ORACLE_SQL, QUERIES, tokenizer
from tests.oracle import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, "A b c"), (6, "x " * 3000), (7, "é ñ ß ▁ 字 \U0001f600\n\nend."), (8, "one two three four five six. " * 40)]


def frame(spark, rows=ODD, more=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if more:  # columns with the operators' own names
        for c in ("rid", "pos", "n", "piece", "cls", "kept", "words"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df.selectExpr("*", "'en' AS lang")


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def random_texts(seed, n=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcde \n") for _ in range(300)) for _ in range(4)]
    make = lambda: "".join(rnd.choice([rnd.choice(base)[rnd.randint(0, 100) : rnd.randint(120, 300)], "".join(rnd.choice("abcde \n") for _ in range(rnd.randint(0, 80))), "ab" * rnd.randint(0, 40)]) for _ in range(rnd.randint(0, 4)))
    return [(i, make()) for i in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark):
    compare(QUERIES[name], ORACLE_SQL[name], spark)


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    rnd = random.Random(1)
    rows = ODD + [(i, "".join(rnd.choice(["a", "the", " ", "  ", "\n", "▁", "é", "字", "ing", "'s", "\t", "<s>", "\x00"]) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    for chunk in (1, 5, 1 << 16):
        got = token_counts.token_counts(frame(spark, rows), tokenizer("piece_bpe_32k.model"), chunk=chunk).collect()
        assert key((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == key((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)


@pytest.mark.parametrize("text", ["x" * 1_000_000, "ab" * 300_000, "the" * 200_000 + " " * 70_000 + "end", "".join(random.Random(7).choice("etaoin shrdlu\n") for _ in range(300_000)).replace(" ", "")])
def test_token_counts_of_long_texts_without_spaces(text):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    assert token_counts.counter(path).count(text) == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))


def test_chunk_maps_lead_from_any_state():
    machine = token_counts.counter(tokenizer("piece_bpe_32k.model")).machine
    rnd = random.Random(3)
    for _ in range(50):
        parts = ["".join(rnd.choice("aaabenst") for _ in range(rnd.randint(1, 12))) for _ in range(4)]
        maps = [token_counts.ChunkMap(machine, p) for p in parts]
        left = token_counts.Composed(token_counts.Composed(token_counts.Composed(*maps[:2]), maps[2]), maps[3])
        right = token_counts.Composed(maps[0], token_counts.Composed(maps[1], token_counts.Composed(*maps[2:])))
        for state in {machine.start, *maps[0].states[:3]}:
            k, total = state, 0
            for c in "".join(parts):
                k, n = machine.edge(k, c)
                total += n
            assert left.after(state) == right.after(state) == (k, total)


def test_packing(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = ODD + [(i, " ".join(["it's", "Don't,", "a.", "...", "x,y", "<|endoftext|>", "É"][: i % 8])) for i in range(20, 60)]
    got = packing.pack(frame(spark, rows), tokenizer("word_bpe_49k.json"), 64).collect()
    expected = []
    for i, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(i, k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for k in range(-(-len(ids) // 64))]
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == key(expected)
    place = defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    for own in place.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]])) and sum(n for _, n in own) <= 64
    assert len(place) <= -(-sum(r.length for r in got) // 64) + 1


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    bins.groups.update({((6, 1), (2, 1)): 1, ((4, 1), (3, 1)): 1, ((5, 1),): 1})
    bins.search()
    assert bins.count() == 2 and sum(bins.fill(c) * m for c, m in bins.groups.items()) == 20


def test_two_for_one_exchange_of_any_gain():
    bins = packing.Bins(100)
    assert bins._step(((20, 1), (18, 1)), ((60, 1), (30, 1))) == ((20, 18), (30,))  # gain 8 of a room of 10
    assert bins._step(((20, 2),), ((60, 1), (35, 1))) == ((20, 20), (35,))
    rnd = random.Random(8)
    for _ in range(2000):
        low, high = (bins.change((), (), tuple(rnd.randint(8, 45) for _ in range(rnd.randint(1, 4)))) for _ in range(2))
        low, high = sorted((low, high), key=bins.fill)
        room = 100 - bins.fill(high)
        if room < 0:
            continue
        own, other = [n for n, k in low for _ in range(k)], [n for n, _ in high]
        gains = own + [x - y for x in own for y in other] + [x + z - y for i, x in enumerate(own) for z in own[:i] for y in other]
        step = bins._step(low, high)
        assert (sum(step[0]) - sum(step[1]) if step else 0) == max((g for g in gains if 0 < g <= room), default=0)


def test_local_search_runs_to_its_end():
    rnd = random.Random(5)
    bins = packing.Bins(4096)
    lengths = Counter(rnd.randint(700, 3000) for _ in range(4000))
    bins.start(lengths)
    first = bins.count()
    bins.search()
    left = Counter()
    for content, many in bins.groups.items():
        for n, k in content:
            left[n] += k * many
    assert left == lengths and bins.count() < first
    under = [c for c in bins.groups if bins.fill(c) < 4096]
    assert bins.count() == bins.least() or not any(bins._step(a, b) for a in under for b in under if bins.fill(b) >= bins.fill(a) and (a != b or bins.groups[a] > 1))


@pytest.mark.parametrize("length,gram", [(40, 16), (60, 60), (33, 8)])
def test_repeated_substrings(spark, length, gram):
    docs = random_texts(3) + [(100, None), (101, ""), (None, "q" * 50)] + random_texts(3)[:1]
    at = defaultdict(list)
    raw = [(t or "").encode() for _, t in docs]
    for k, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            at[b[s : s + length]].append((k, s))
    gone = [bytearray(len(b)) for b in raw]
    for places in at.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + length] = b"\1" * length
    spans = lambda g: sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
    expected = [(i, len(b), sum(g), spans(g), hashlib.sha256(bytes(c for c, x in zip(b, g) if not x)).hexdigest()) for (i, _), b, g in zip(docs, raw, gone)]
    assert key(substrings.remove_repeats(frame(spark, docs), length, gram).collect()) == key(expected)


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    low = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    return [(i, len(s), low[r], i is not None and i == low[r]) for (i, _), s, r in zip(rows, sets, root)]


def test_near_duplicates(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = list(ODD)
    for i in range(20, 60):
        w = list(base) if i < 50 else [f"v{rnd.randint(0, 400)}" for _ in range(120)]
        for _ in range(i % 7):
            w[rnd.randrange(120)] = f"u{rnd.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    df = frame(spark, rows)
    assert key(near_dups.near_duplicates(df).collect()) == key(brute_near(rows))
    kept = near_dups.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id and r.doc_id >= 20) == sorted(i for i, _, c, k in brute_near(rows) if i and i >= 20 and k)


def test_parities_drop_no_link(spark):
    rnd = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([12, 80, 700]))]
        for k in range(25):
            w = list(base)
            for _ in range(int(len(w) * k / 400)):
                w[rnd.randrange(len(w))] = f"u{rnd.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    assert key(near_dups.near_duplicates(frame(spark, rows)).collect()) == key(brute_near(rows))


def test_quality_measures_and_bounds(spark):
    rows = ODD + [(i, t) for i, t in random_texts(9, 30)] + [(300, "##### $$$ a b c d e f g h i j k\nfoo bar\nfoo bar\n \n \n")]
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, None, 0), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    expected = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = len({k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)})
        own = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * repeat > 20 * len(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), repeat, failed, not failed))
    got = quality.quality_rules(frame(spark, rows), labels).collect()
    assert key(got) == key(expected)
    assert quality.admissible(0, 300, 0.01, 0.05) and not quality.admissible(0, 298, 0.01, 0.05) and not quality.admissible(1, 300, 0.01, 0.05)


def test_certified_cutoffs_reject_junk_and_keep_good(spark):
    good = [(i, "plain words that a good text has and some more of them " + str(i)) for i in range(4000)]
    junk = [(5000 + i, "### $$$ %%% &&& *** ||| ### $$$ a%% b## c$$ " + str(i)) for i in range(50)]
    df = frame(spark, good + junk, False)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(df, labels).collect()}
    assert kept == {i for i, _ in good}


def test_every_language_has_its_own_cutoffs(spark):
    rows = [(1000 * g + i, f"l{g}", "plain words that a good text has and some more of them " + str(i)) for g in range(70) for i in range(10)]
    rows += [(200_000 + i, "l5", "plain words that a good text has and some more of them " + str(i)) for i in range(5000)]
    rows += [(300_000 + g, f"l{g}", "### $$$ %%% &&& *** ||| ### $$$ a%% b## c$$") for g in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows if i < 300_000], "doc_id long, quality int")
    gone = {r.doc_id for r in quality.quality_rules(df, labels).where("NOT kept").collect()}
    assert gone == {300_005}  # the only language with labels enough to certify a cutoff


def test_line_dedup_keeps_rows(spark):
    rows = [(1, "the quick brown fox jumps over it\nshort\nshort"), (2, "x\nthe quick brown fox jumps over it\nit over jumps fox brown quick the"), (3, None), (4, ""), (5, "a b")]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got == {1: "the quick brown fox jumps over it\nshort\nshort", 2: "x", 3: None, 4: "", 5: "a b"}


def test_line_dedup_of_very_long_lines(spark):
    rows = []
    for n in (100, 127, 128, 200, 255, 256, 1100, 5000):
        words = [f"n{n}w{k}" for k in range(n)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, "y" + str(n) + "\n" + " ".join(words[::-1])), (10 * n + 2, " ".join(words[n // 20 :])), (10 * n + 3, " ".join(words[: n // 2]))]
    got = {r.doc_id: r.n_removed for r in lines.line_digest(frame(spark, rows)).collect()}
    assert got == {i: int(i % 10 in (1, 2)) for i, _ in rows}


def test_decontamination_odd_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (4, item)], "item_id long, text string")
    rows = ODD + [(50, "before it " + item.upper() + " after it"), (51, "Tiny item"), (52, item.replace("iota", "jota")), (53, "tiny item here")]
    got = decontam.leaked_items(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(50, 1), (50, 4), (51, 4)}
    kept = decontam.without_leaks(frame(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {50, 51}


def test_html(spark):
    made = html_text.labelled_pages(120, 77)
    w, t = html_text.model()
    right = [a == b for p, y in made for a, b in zip(html_text.decode(html_text.features(html_text.blocks(p)), w, t), y)]
    assert sum(right) / len(right) > 0.95
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Big &amp; news</h1><p>It was  a\nlong day for all of the people there.<p>The <b>end</b> came.</article><footer>&copy; me</footer>")], "page_id long, url string, html string")
    pages = pages.union(spark.createDataFrame([(4, "u", "<article><p title=it's data-id='nav'>Hello there, all of you who came to read this.</p><p title=\"a > b\">And more of it.</article>")], pages.schema)).withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert html_text.extract(pages.limit(0)).count() == 0 and got.pop(4) == "Hello there, all of you who came to read this. And more of it."
    assert got == {1: "", 2: "", 3: "Big & news It was a long day for all of the people there. The end came."}


def test_licenses(spark):
    rows = ODD + [(60, "Intro.\nreleased UNDER the MIT license. More."), (61, "This program is free software; you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.")]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(60, "MIT"), (61, "GPL-notice")} | ({(61, "LGPL-notice")} & {(r.doc_id, r.license) for r in got})
    m = next(r for r in got if r.license == "MIT")
    assert rows[-2][1].encode()[m.start_byte : m.end_byte] == b"released UNDER the MIT license" and (m.n_matched, m.n_template) == (5, 5)


NOTICES = [
    ("Licensed under CC BY 4.0", "CC-BY-4.0-short"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0-short"),
    ("Released under the GPL License", "GPL"),
    ("Released under the BSD License", "BSD"),
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("Mozilla License, Version 2.0", None),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("All rights reserved.", "All-rights-reserved"),
    ("Released under the new MIT License", "MIT"),
    ("Licensed under the Apache License, Version 3.0", None),
    ("released from the public domain of the license", None),
]


def test_licenses_that_one_word_tells_apart(spark):
    rows = [(i, "Some words before it. " * (i % 3) + text + " and words after" * (i % 2)) for i, (text, _) in enumerate(NOTICES)]
    rows.append((99, " ".join(f"word{i}" for i in range(50_000)) + " Licensed under CC BY-NC 4.0"))
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {(i, name) for i, (_, name) in enumerate(NOTICES) if name} | {(99, "CC-BY-NC-4.0")}


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_equals_the_full_table():
    rnd = random.Random(6)
    for _ in range(300):
        a = [rnd.randint(0, 6) for _ in range(rnd.randint(1, 9))]
        b = [rnd.randint(0, 6) for _ in range(rnd.randint(1, 9))]
        n, first, end = licenses.align(a, b, 0, band=20)
        assert n == longest(a, b) == longest(a, b[first:end])


def test_lm_prefers_seen_order(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["red fox runs", "blue bird flies", "old man sleeps"]) for _ in range(30))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "fox red runs bird blue flies man old sleeps " * 10), (903, "red fox runs blue bird flies old man sleeps " * 10)]
    got = {r.doc_id: r for r in pseudo_lm.score(frame(spark, rows)).collect()}
    assert got[900].n_words == 0 and got[901].log_likelihood == 0 and got[903].per_word > got[902].per_word


def test_lm_scores_rare_words_by_their_counts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 100, i * 100 + 100)) + " again" * (i == 7)) for i in range(150)]
    rows += [(200 + i, f"w{k}") for i, k in enumerate([14990] * 3)]
    parts = pseudo_lm.word_blocks(frame(spark, rows, False)).cache()
    counted = pseudo_lm.word_counts(parts).cache()
    lexicon = pseudo_lm.Lexicon(counted)
    own = counted.where("own").select("word", "n", lexicon.class_of().alias("cls")).collect()
    assert len(own) == 15001 and sorted(r.n for r in own)[-2:] == [1, 4]
    share = defaultdict(float)
    for r in own:
        share[r.cls] += r.n / lexicon.total[r.cls]
    assert all(abs(s - 1) < 1e-9 for s in share.values())
    inner = {r.doc_id: r.inner for r in pseudo_lm.classed(parts, counted, lexicon).collect()}
    assert abs(sum(v for i, v in inner.items() if i < 200) + 3 * inner[200] - sum(r.n * np.log(r.n / lexicon.total[r.cls]) for r in own)) < 1e-6


def test_empty_tables(spark):
    df = frame(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (packing.pack(df, tokenizer("word_bpe_49k.json")), token_counts.token_counts(df, tokenizer("piece_bpe_32k.model")), substrings.remove_repeats(df), decontam.leaked_items(df, bench), near_dups.near_duplicates(df), licenses.scan_licenses(df), pseudo_lm.score(df), quality.quality_rules(df, labels), lines.line_digest(df)):
        assert out.count() == 0
