"""Line dedup against all pairs of lines, with hot and split words at sizes that small tables reach."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_pairs(rows, share=(85, 100)):
    """doc_id, lines, removed, hash of what stays, of every row in order; null doc_ids come last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    before, out = [], {}
    for k in order:
        own, kept, gone = (rows[k][1] or "").split("\n"), [], 0
        for line in own:
            words = set(WORD.findall(line))
            if words and any(len(words & b) * share[1] >= len(words | b) * share[0] for b in before):
                gone += 1
            else:
                kept.append(line)
            before.append(words)
        out[k] = rows[k][0], len(own), gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return sorted(out.values(), key=repr)


def near_copies(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(60))]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice((1, 2, 3, 7, 12, 20, 40)))] for _ in range(40)]

    def line():
        words = list(rnd.choice(base)) if rnd.random() < 0.6 else [f"u{rnd.randint(0, 9999)}" for _ in range(9)] + ["the"]
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 99)}"
        rnd.shuffle(words)
        return rnd.choice((" ", "  ", "\t")).join(words)

    rows = [(i, "\n".join([line() for _ in range(rnd.randint(1, 4))] + ["", "Home"] * rnd.randint(0, 1))) for i in range(n)]
    return rows + [rows[3], rows[3], (4, "an own line of an equal id"), (4, "an own line of an equal id"), (None, rows[5][1]), (None, None), (500, "")]


@pytest.fixture(scope="module")
def cases():
    return [(rows := near_copies(seed), all_pairs(rows)) for seed in (1, 2)]


@pytest.mark.parametrize("split, hot", [(2, 3), (2, 1000), (4, 3), (4, 1000), (20, 3), (20, 1000)])
def test_no_pair_is_lost(spark, monkeypatch, cases, split, hot):
    monkeypatch.setattr(lines, "SPLIT", split)
    monkeypatch.setattr(lines, "HOT", hot)
    for rows, expected in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "1 AS w", "2 AS near", "3 AS part")
        assert sum(e[2] for e in expected) > 60
        assert sorted(map(tuple, lines.line_digest(df).collect()), key=repr) == expected


def long_lines(seed, n=60):
    """Lines of 100 to 400 words, half of them copies with a few per cent of the words changed; all have a rare word of a few."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        if k % 2:
            words = list(out[rnd.randrange(len(out))])
            for _ in range(rnd.randrange(int(0.12 * len(words)))):
                words[rnd.randrange(len(words))] = f"y{rnd.randint(0, 10**9)}"
        else:
            words = [f"v{rnd.randint(0, 3000)}" for _ in range(rnd.choice((100, 127, 128, 200, 300, 400)))]
        out.append([*words, f"rare{rnd.randint(0, 2)}"])
    return [(k, " ".join(words)) for k, words in enumerate(out)]


@pytest.mark.parametrize("rows_sent", [0, 200_000])
def test_long_lines_equal_all_pairs(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", rows_sent)
    rows = long_lines(5)
    got = sorted(map(tuple, lines.line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == all_pairs(rows)
    assert 10 < sum(x[2] for x in got) < 30


def test_unlike_long_lines_are_no_partners(spark):
    rnd = random.Random(3)
    rows = [(k, k, " ".join([*(f"z{rnd.randint(0, 10**6)}" for _ in range(240)), "met"])) for k in range(60)]
    df = spark.createDataFrame(rows, "rid long, doc_id long, text string")
    kinds = lines.numbered_classes(lines.line_sets(df, F.array(F.lit(0).cast("long")), 1, lines.SHARE))
    a, b = (kinds.select(F.lit(0).alias("i"), *[c for c in lines.OWN if c != "i"]).select(*[F.col(c).alias(f"{s}_{c}") for c in lines.OWN]) for s in "ab")
    both = a.crossJoin(b).where("a_id < b_id")
    assert both.count() == 60 * 59 // 2
    assert both.where(lines.may_match(lines.SHARE)).count() == 0
