"""Conversation repair against all edit sequences, and its two routes against each other."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tarnbeck.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def replay(rows, edits, start=""):
    """(cost, role initials) of a sequence of edits; None if it isn't one for these rows."""
    cost, out, at, state = 0, start, 0, {"": "u", "s": "u", "a": "u", "u": "a"}
    for e in edits:
        want = state[out[-1:]]
        if e == "I":
            cost, out = cost + 2, out + want
            continue
        if at == len(rows):
            return None
        initial, fault, _ = rows[at]
        at += 1
        if e == "D":
            cost += 3
            continue
        if fault == C.GONE or e == "K" and not initial:
            return None
        cost += (fault == C.CUT) + 2 * (e == "R")
        out += want if e == "R" else initial
        if not re.fullmatch("(s?(ua)*u?)?", out):
            return None
    return (cost, out) if at == len(rows) else None


def best(rows):
    found = []
    for n in range(len(rows), len(rows) + 4):
        for edits in itertools.product("DIKR", repeat=n):
            if (r := replay(rows, edits)) and re.fullmatch("(s?(ua)+)?", r[1]):
                found.append((r[0], "".join(edits)))
    return min(found)


def test_search_finds_the_least_of_all_edits():
    rnd = random.Random(1)
    cases = [[], [("", 0, 1)], [("x", 0, 1)], [("u", 2, 1), ("u", 2, 1)]] + [[(rnd.choice("suax"), rnd.choice((0, 0, 0, 1, 2)), 1) for _ in range(rnd.randint(1, 4))] for _ in range(40)]
    for rows in cases:
        assert next(iter(C.search(rows).values())) == best(rows), rows


def test_equal_rows_are_searched_as_if_written_out():
    rnd = random.Random(2)
    for _ in range(200):
        rows = [(rnd.choice("suax"), rnd.choice((0, 0, 1, 2)), rnd.choice((1, 1, 2, 3))) for _ in range(rnd.randint(1, 6))]
        long = [x for i, f, n in rows for x in [(i, f, 1)] + [(i, C.GONE, 1)] * (n - 1)]
        assert C.search(rows) == C.search(long)


def reference(rows):
    """The contract's columns of one list of rows, one step after another."""
    conv = {}
    for c, turn, role, text in rows:
        conv.setdefault(c, [])
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conv[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, own in conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, lattice, n = set(), [], [0, 0, 0]
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            lattice.append((role[:1], (C.GONE, C.GONE, C.CUT, C.FINE)[fault], 1))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = next(iter(C.search(lattice).values()))
        out, at, state = [], iter(own), ""
        for e in audit:
            want = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
            name = {"u": "user", "a": "assistant"}[want]
            if e == "I":
                out, state = out + [name + ":"], want
                continue
            _, role, text = next(at)
            if e == "R":
                out, state = out + [f"{name}:{text}"], want
            elif e == "K":
                out, state = out + [f"{role}:{text}"], role[:1]
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(lattice, lattice[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield c, gaps, *n, pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "Yes.", "No", "Well!\n", "Why? \x0b", "a. b", "É ü 字?", "x ", "　", "tail.\x00"]
    return [(rnd.choice([None, 1, 2, 3, 4, 5, 6, -7]), rnd.choice([None, None, *range(30)]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]), rnd.choice(texts)) for _ in range(n)]


def digest(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS fault", "2 AS copies", "3 AS kind", "4 AS own")
    return sorted(map(tuple, C.repair_digest(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_both_routes_equal_the_steps_written_out(spark, monkeypatch, seed):
    rows = random_rows(seed) + [(9, 1, "user", "Hi."), (9, 1, "user", "Hi."), (10, None, None, None), (11, 0, "assistant", "x " * 30_000)]
    rows += [(50 + i, 0, "user", "Only one.") for i in range(40)]  # two of them are dropped whole
    expected = sorted(reference(rows), key=repr)
    assert digest(spark, rows) == expected
    monkeypatch.setattr(C, "LONG_ROWS", 3)
    for bits in (0, 2):
        monkeypatch.setattr(C, "CHUNK", bits)
        assert digest(spark, rows) == expected


def test_bytes_make_a_conversation_long_too(spark, monkeypatch):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i} " + "z" * 200 + ".") for i in range(20)] + [(2, 0, "user", "a.")]
    expected = sorted(reference(rows), key=repr)
    monkeypatch.setattr(C, "LONG_BYTES", 1000)
    assert digest(spark, rows) == expected


def test_a_long_conversation_of_repeated_rows(spark):
    rows = [(1, 5, "user", "Again?")] * 700 + [(1, i, ("user", "assistant")[i % 2], f"line {i}.") for i in range(6, 900)]
    assert digest(spark, rows) == sorted(reference(rows), key=repr)


def test_no_rows(spark):
    assert digest(spark, []) == []


def test_repair_gives_the_turns_themselves(spark, monkeypatch):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (2, 0, "user", "No answer."), (3, 0, "assistant", " ")]
    for limit in (300, 1):
        monkeypatch.setattr(C, "LONG_ROWS", limit)
        report, turns = C.repair(spark.createDataFrame(rows, SCHEMA))
        said = {}
        for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.place)):
            said.setdefault(r.conv_id, []).append(f"{r.role}: {r.text}")
        assert said == {1: ["system: Be kind.", "user: Hi.", "assistant: Hello?"], 2: ["user: No answer.", "assistant: "]}
        assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (2, "KKR"), 2: (2, "KI"), 3: (3, "D")}
