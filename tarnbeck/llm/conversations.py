"""Repair of conversations: the cheapest edits that give a well-formed sequence of roles.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then text). A row's first fault counts:
blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the last
character that isn't white space is none of `.!?`). Role initials have to give `(s?(ua)+)?`, which a machine of four
states reads: begun, after s, after u, after a; each state admits one role to insert or to rerole to. Edits are Keep (0),
Rerole (2), Delete (3, required for blank and duplicate rows) and Insert of an empty turn (2); a truncated row that stays
adds 1.

Dijkstra's search runs on the lattice (rows read, state), which is made as it is explored, with (cost, audit) as the key
of the queue, audit being the initials of the edits so far, and stops at the first accepting end node that it takes. Of
two paths of one cost to a node neither audit begins the other (the rest would be inserts, which cost), so their order
stays when edits are appended, and the first to be taken is the least.

Conversations of at most LONG_ROWS rows and LONG_BYTES bytes are searched whole, one at a time. Longer ones are cut into
chunks, wherever their rows lie: a search from each state gives a chunk's cheapest (cost, audit) to each state, and these
maps are folded along the conversation. Equal rows are counted before they are sorted, so a row that is repeated without
end is one row with a number. Texts of a long conversation are only streamed: its rows are cut by range, and its digest,
which is one hash of all its text, is fed row by row. What one task holds of it is an edit's letter a row.

Cases: null roles and texts are one space; null conv_ids are one conversation. A role of any other initial, or without
one, can't be kept. A conversation without rows (all dropped by the damage) has zeros, an empty audit and the hash of the
empty text. An empty table gives no rows. Extra columns fall away.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch

LONG_ROWS, LONG_BYTES = 300, 16_000_000
#: Bits of the row numbers within a chunk of a long conversation: 256 rows.
CHUNK = 8
BEGUN, S, U, A = range(4)
#: The state that each initial leads to, by state, and the role that may be put in.
READ = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
PUT = ((U, "user"), (U, "user"), (A, "assistant"), (U, "user"))
ENDS = (BEGUN, A)
FINE, GONE, CUT = range(3)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_SPACE, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

#: A row of the lattice: initial of the role, FINE, GONE (has to be deleted) or CUT (truncated), number of equal rows.
Row = tuple[str, int, int]


def search(rows: list[Row], start: int = BEGUN, every: bool = False) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) to the first accepting end state; with `every`, to each state that can be reached.

    Rows after the first of equal ones are duplicates. Their deletions follow at once: an insert before a deletion makes
    a larger audit at the same cost than one behind it.
    """
    queue, done, found = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and (every or state in ENDS):
            found[state] = cost, audit
            if not every:
                break
        put = PUT[state][0]
        heapq.heappush(queue, (cost + 2, audit + "I", at, put))
        if at == len(rows):
            continue
        initial, fault, copies = rows[at]
        after, rest = 3 * (copies - 1), "D" * (copies - 1)
        heapq.heappush(queue, (cost + 3 + after, audit + "D" + rest, at + 1, state))
        if fault != GONE:
            stays = cost + after + (fault == CUT)
            heapq.heappush(queue, (stays + 2, audit + "R" + rest, at + 1, put))
            if (to := READ[state].get(initial)) is not None:
                heapq.heappush(queue, (stays, audit + "K" + rest, at + 1, to))
    return found


def applied(rows: list[Row], audit: str, state: int = BEGUN) -> tuple[list[tuple[list[str], str | None, list[str]]], int]:
    """For each row the roles put in before it, its role (None: deleted, '': kept) and, for the last, those behind it; the state after."""
    out, before, edits = [], [], iter(audit)
    for initial, _, copies in rows:
        edit = next(edits)
        while edit == "I":
            state, role = PUT[state]
            before.append(role)
            edit = next(edits)
        role = None
        if edit == "R":
            state, role = PUT[state]
        elif edit == "K":
            state, role = READ[state][initial], ""
        out.append((before, role, []))
        before = []
        for _ in range(copies - 1):
            next(edits)
    for _ in edits:
        state, role = PUT[state]
        (out[-1][2] if out else before).append(role)
    return out, state


def illegal(rows: list[Row]) -> int:
    """Neighbours whose initials are none of su, ua, au."""
    return sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:])) + sum(r[2] - 1 for r in rows)


def runs(batches, *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each run of equal keys, across batches."""
    own, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in keys)
            if own and k != key:
                yield key, own
                own = []
            key = k
            own.append(row)
    if own:
        yield key, own


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped, 2: repeated) after the damage that `conv_id:turn` fixes."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("own", ".!?", "")).otherwise(F.col("own"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("own"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _plain(conversations: DataFrame) -> DataFrame:
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own("role"), own("text"), F.lit(1).cast("long").alias("copies"))


def _fault(text: Column) -> Column:
    """FINE, GONE (blank) or CUT of a text by itself."""
    return F.when(~F.rlike(text, F.lit(_SOLID)), GONE).when(~F.rlike(text, F.lit(rf"[.!?]{_SPACE}*\z")), CUT).otherwise(FINE)


def _by_turn() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _short(rows: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit, turns (role, text of the repaired conversation) of conversations that fit a task."""

    def repair(batches):
        for (conv,), own in runs(batches, "conv_id"):
            own = [r for r in own if r["copies"]]
            turns = {r["turn"] for r in own} - {None}
            seen, lattice, n = set(), [], [0, 0, 0]
            for r in own:
                key, fault = (r["role"], r["text"]), r["fault"]
                again = fault != GONE and key in seen
                seen.add(key)
                n[1] += again
                n[0 if fault == GONE else 1] += r["copies"] - 1
                n[0] += fault == GONE
                n[2] += fault == CUT and not again
                lattice.append((r["role"][:1], GONE if again else fault, r["copies"]))
            ((cost, audit),) = search(lattice).values()
            out = []
            for r, (before, role, behind) in zip(own, applied(lattice, audit)[0], strict=True):
                out += [{"role": x, "text": ""} for x in before]
                out += [] if role is None else [{"role": role or r["role"], "text": r["text"]}]
                out += [{"role": x, "text": ""} for x in behind]
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            values = [conv, gaps, *n, illegal(lattice), cost, audit, out]
            yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in values[:7]], pa.array([audit]), pa.array([out], _TURNS)], names)

    names = ["conv_id", *COUNTS, "audit", "turns"]
    ordered = rows.withColumn("fault", _fault(F.col("text"))).repartition("conv_id").sortWithinPartitions(*_by_turn())
    return ordered.mapInArrow(repair, ", ".join(f"{c} long" for c in names[:7]) + ", audit string, turns array<struct<role: string, text: string>>")


def _join(left: DataFrame, right: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """left with right's other columns, where null keys are equal."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how).drop(*[f"_{k}" for k in keys])


def _ordered(rows: DataFrame) -> DataFrame:
    """The different rows of long conversations with their number (pos), initial, fault and copies, as a written table."""
    scratch = Scratch(rows.sparkSession)
    each = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # Beginnings of role and text sort as the whole ones do, and keep what the driver samples small.
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 20), F.substring("text", 1, 60)]
    placed = scratch.keep(each.repartitionByRange(*keys).sortWithinPartitions(*_by_turn()).withColumn("pos", F.monotonically_increasing_id()), "turns")
    first = placed.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = _join(placed, first, "conv_id", "role", "text").withColumn("again", F.col("pos") > F.col("first"))
    fault = _fault(F.col("text"))
    again = F.coalesce("again", F.lit(False)) & (fault != GONE)
    out = met.select("conv_id", "turn", "role", "text", "copies", "pos", F.substring("role", 1, 1).alias("initial"), again.alias("again"), F.when(again, GONE).otherwise(fault).alias("fault"))
    done = scratch.keep(out, "faults")
    scratch.drop(placed)
    return done


def _lattice(rows: list[dict]) -> list[Row]:
    return [(r["initial"], r["fault"], r["copies"]) for r in rows]


class _Step:
    """The cheapest way to a state behind a chunk: the step before, this chunk's part of the audit, the cost so far."""

    __slots__ = ("before", "part", "cost", "state")

    def __init__(self, before: _Step | None, part: str, cost: int, state: int):
        self.before, self.part, self.cost, self.state = before, part, cost, state

    def less(self, other: _Step) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, own, its = self, other, [], []
        while a is not b:  # as many chunks each, from where the two ways part
            own.append(a.part)
            its.append(b.part)
            a, b = a.before, b.before
        return "".join(reversed(own)) < "".join(reversed(its))

    def way(self) -> list[_Step]:
        out, step = [], self
        while step.before:
            out.append(step)
            step = step.before
        return out[::-1]


def _maps(codes: DataFrame) -> DataFrame:
    """conv_id, chunk, ways (from, to, cost, audit of the chunk), first and last initial, illegal neighbours of every chunk."""
    way = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("part", pa.string())]))

    def reckon(batches):
        for (conv, chunk), own in runs(batches, "conv_id", "chunk"):
            rows = _lattice(own)
            ways = [{"begin": s, "end": t, "cost": c, "part": p} for s in range(4) for t, (c, p) in search(rows, s, True).items()]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array([ways], way), pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([illegal(rows)], pa.int64())], ["conv_id", "chunk", "ways", "head", "tail", "illegal"])

    placed = codes.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos")
    return placed.mapInArrow(reckon, "conv_id long, chunk long, ways array<struct<begin: int, end: int, cost: long, part: string>>, head string, tail string, illegal long")


def _folded(maps: DataFrame) -> DataFrame:
    """conv_id, chunk, state (before the chunk), part (of the audit) of every chunk; chunk null: illegal, cost and audit of the whole."""
    names = ["conv_id", "chunk", "state", "part", "illegal", "cost"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def stream(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def finish(conv, steps, chunks, wrong):
        end = None
        for state in ENDS:
            if (step := steps.get(state)) and (end is None or step.less(end)):
                end = step
        way = end.way()
        out = [(conv, c, s.before.state, s.part, None, None) for c, s in zip(chunks, way, strict=True)]
        out.append((conv, None, None, "".join(s.part for s in way), wrong, end.cost))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    def fold(batches):
        conv, chunks, steps, wrong, tail = None, [], {}, 0, ""
        for row in stream(batches):
            if chunks and row["conv_id"] != conv:
                yield finish(conv, steps, chunks, wrong)
                chunks = []
            if not chunks:
                conv, steps, wrong = row["conv_id"], {BEGUN: _Step(None, "", 0, BEGUN)}, 0
            elif (tail, row["head"]) not in LEGAL:
                wrong += 1
            new: dict[int, _Step] = {}
            for w in row["ways"]:
                if before := steps.get(w["begin"]):
                    step = _Step(before, w["part"], before.cost + w["cost"], w["end"])
                    if w["end"] not in new or step.less(new[w["end"]]):
                        new[w["end"]] = step
            chunks.append(row["chunk"])
            steps, wrong, tail = new, wrong + row["illegal"], row["tail"]
        if chunks:
            yield finish(conv, steps, chunks, wrong)

    ordered = maps.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(fold, "conv_id long, chunk long, state int, part string, illegal long, cost long")


def _decided(codes: DataFrame, parts: DataFrame) -> DataFrame:
    """pos, before, role (null: deleted, empty: kept), behind of every row."""
    none = lambda kind: F.lit(None).cast(kind)
    all_ = codes.select("conv_id", "chunk", "pos", "initial", "fault", "copies", none("int").alias("state"), none("string").alias("part")).union(
        parts.select("conv_id", "chunk", F.lit(-1).cast("long"), none("string"), none("int"), none("long"), "state", "part")
    )

    def decide(batches):
        for _, own in runs(batches, "conv_id", "chunk"):
            head, rows = own[0], own[1:]
            out = applied(_lattice(rows), head["part"], head["state"])[0]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r["pos"] for r in rows], pa.int64()), pa.array([o[0] for o in out], texts), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], texts)], ["pos", "before", "new", "behind"])

    return all_.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(decide, "pos long, before array<string>, new string, behind array<string>")


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, counts, cost, audit), (conv_id, pos, turns: role and text of what a row becomes) of long conversations."""
    scratch = Scratch(rows.sparkSession)
    placed = _ordered(rows)
    codes = placed.select("conv_id", F.shiftright("pos", CHUNK).alias("chunk"), "pos", "initial", "fault", "copies")
    folded = scratch.keep(_folded(_maps(codes)), "folded")
    decided = _decided(codes, folded.where("chunk IS NOT NULL"))
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("new").isNull(), F.array().cast("array<struct<role: string, text: string>>")).otherwise(F.array(F.struct(F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")).alias("role"), "text")))
    turns = placed.select("conv_id", "pos", "role", "text").join(decided, "pos").select("conv_id", "pos", F.concat(empty("before"), own, empty("behind")).alias("turns")).where(F.size("turns") > 0)
    blank = (F.col("fault") == GONE) & ~F.col("again")
    span = F.max("turn") - F.min("turn") + 1
    counts = placed.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("span"), F.sum(F.when(blank, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(F.col("again"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"), F.sum((F.col("fault") == CUT).cast("long")).alias("truncated"))
    distinct = placed.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("distinct"))
    whole = folded.where("chunk IS NULL").select("conv_id", "illegal", "cost", F.col("part").alias("audit"))
    every = rows.select("conv_id").distinct()
    out = every
    for part in (counts, distinct, whole):
        out = _join(out, part, "conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = (F.col("span") - zero(F.col("distinct"))).alias("gaps")
    report = out.select("conv_id", zero(gaps).alias("gaps"), *[zero(F.col(c)).alias(c) for c in COUNTS[1:]], F.coalesce("audit", F.lit("")).alias("audit"))
    return report, turns


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that one task can hold, and the others (None if there are none)."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    large = Scratch(rows.sparkSession).keep(sizes.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("conv_id"), "long")
    if large.isEmpty():
        return rows, None
    return _join(rows, large, "conv_id", how="left_anti"), _join(rows, large, "conv_id", how="left_semi")


def _repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    some, more = _split(rows)
    return (_short(some), *(_long(more) if more is not None else (None, None)))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations as they are: a report (conv_id, counts, cost, audit) and the repaired turns (conv_id, place, role, text).

    Places rise along a conversation, in steps of any size.
    """
    short, report, turns = _repaired(_plain(conversations))
    short = Scratch(conversations.sparkSession).keep(short, "repaired")
    reports, rows = short.drop("turns"), short.select("conv_id", F.posexplode("turns").alias("place", "t")).select("conv_id", F.col("place").cast("long").alias("place"), "t.*")
    if report is None:
        return reports, rows
    spread = turns.select("conv_id", F.col("pos"), F.posexplode("turns").alias("i", "t")).select("conv_id", (F.shiftleft("pos", 8) + F.col("i")).alias("place"), "t.*")
    return reports.union(report), rows.union(spread)


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _hashes(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of long conversations, fed with a row at a time."""

    def feed(batches):
        state, conv, begun = hashlib.sha256(), None, False
        done = lambda: pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            for own, text in zip(batch.column("conv_id"), batch.column("lines")):
                if begun and own.as_py() != conv:
                    yield done()
                    state, begun = hashlib.sha256(), False
                state.update(b"\n" if begun else b"")
                state.update(text.as_buffer())
                conv, begun = own.as_py(), True
        if begun:
            yield done()

    lines = turns.select("conv_id", "pos", _lines(F.col("turns")).alias("lines"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "lines").mapInArrow(feed, "conv_id long, repaired_sha256 string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after the damage."""
    short, report, turns = _repaired(damage(conversations))
    out = short.select("conv_id", *COUNTS, "audit", F.sha2(_lines(F.col("turns")), 256).alias("repaired_sha256"))
    if report is None:
        return out
    joined = _join(report, _hashes(turns), "conv_id").select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return out.union(joined)


#: The same by dynamic programming over all rows and states, with crc32 reckoned from its polynomial.
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(n))),
own AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::UBIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM own WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
    left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faults AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 0 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, (0::BIGINT, '') AS best FROM counts
  UNION ALL
  SELECT e.conv_id, e.i, e.to.st AS st, min(e.to.best) AS best FROM (
    SELECT s.conv_id, s.i + 1 AS i, unnest(
      [{'st': s.st, 'best': (s.cost + 3, s.audit || 'D')}]
      || CASE WHEN f.fault IN ('b', 'd') THEN [] ELSE [{'st': CASE s.st WHEN 2 THEN 3 ELSE 2 END, 'best': (s.cost + 2 + (f.fault = 't')::BIGINT, s.audit || 'R')}] END
      || CASE WHEN f.fault NOT IN ('b', 'd') AND (s.st = 0 AND f.c IN ('s', 'u') OR s.st IN (1, 3) AND f.c = 'u' OR s.st = 2 AND f.c = 'a')
         THEN [{'st': CASE f.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'best': (s.cost + (f.fault = 't')::BIGINT, s.audit || 'K')}] ELSE [] END) AS to
    FROM (
      SELECT conv_id, i, unnest([st, CASE st WHEN 2 THEN 3 ELSE 2 END, CASE st WHEN 2 THEN 2 ELSE 3 END]) AS st, best[1] + unnest([0, 2, 4]) AS cost, best[2] || unnest(['', 'I', 'II']) AS audit FROM walk) s
    JOIN faults f ON f.conv_id = s.conv_id AND f.i = s.i) e
  GROUP BY ALL),
ends AS (
  SELECT conv_id, min((cost, audit)) AS best FROM (
    SELECT w.conv_id, unnest([st, CASE st WHEN 2 THEN 3 ELSE 2 END, CASE st WHEN 2 THEN 2 ELSE 3 END]) AS st, best[1] + unnest([0, 2, 4]) AS cost, best[2] || unnest(['', 'I', 'II']) AS audit
    FROM walk w JOIN counts c ON c.conv_id = w.conv_id AND c.n = w.i) WHERE st IN (0, 3) GROUP BY conv_id),
told AS (
  SELECT conv_id, best[2] AS audit, 1::BIGINT AS p, 0::BIGINT AS i, 0 AS st, []::VARCHAR[] AS lines FROM ends
  UNION ALL
  SELECT t.conv_id, audit, p + 1, t.i + (e <> 'I')::BIGINT,
    CASE WHEN e = 'D' THEN st WHEN e = 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN st = 2 THEN 3 ELSE 2 END,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text] ELSE lines || [CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END] END
  FROM (SELECT *, substr(audit, p, 1) AS e FROM told WHERE p <= length(audit)) t LEFT JOIN faults f ON f.conv_id = t.conv_id AND f.i = t.i)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best[1], 0) AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id)
  LEFT JOIN (SELECT conv_id, lines FROM told WHERE p = length(audit) + 1) t USING (conv_id)"""
