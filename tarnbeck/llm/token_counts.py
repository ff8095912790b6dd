"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The tokenizer's merges become a deterministic transducer over characters. A state holds what decides the rest: the
longest suffix read that some piece can still extend, with the last token and the token count at each position in
that suffix. Every transition is annotated with the number of tokens it emits (negative where a merge takes tokens
back). States are built when first reached; a character that no piece holds, and a space after anything but a
space, lead back to the start state.

A long text is read in chunks. A chunk's map leads from the state before it to the state after it and the tokens
emitted between. Maps compose in pairs, level by level, in a parallel prefix scan of log depth. Most states run into
the same one after a few characters, so a map keeps one run and where others meet it; where they don't (a run of one
letter), the other state is run to the end, which is exact as well. Shorter texts are cut at marks, where every run is
back in the start state; their words are remembered with their counts.

Nulls count as empty texts; empty texts have no tokens; repeated rows are counted each; a text of any length is
read whole. Extra columns fall away.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import only, slices

MARK = "▁"
#: Words that a worker remembers with their count, and states that it keeps, at most; both start anew when full.
MEMO_WORDS, STATES = 600_000, 400_000
CHUNK_CHARS = 1 << 16
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]*")


class Merges:
    """Which neighbouring tokens byte-pair encoding leaves apart.

    pieces: each mergeable piece and its score; of two mergeable pairs the one with the higher score goes first,
    then the one further left.
    """

    def __init__(self, pieces: dict[str, float]):
        self.score = pieces
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.whole: dict[str, bool] = {}
        self.apart: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[str]:
        """Plain byte-pair encoding, by definition; for short texts."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def reachable(self, piece: str) -> bool:
        """Whether encoding ever yields the piece."""
        if (r := self.whole.get(piece)) is None:
            r = self.whole[piece] = len(piece) == 1 or self.encode(piece) == [piece]
        return r

    def compatible(self, left: str, right: str) -> bool:
        if (r := self.apart.get((left, right))) is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            r = self.apart[left, right] = self.encode(left + right) == [left, right]
        return r


class Transducer:
    """step(state, char) -> (next state, tokens emitted), determinised as it is used."""

    def __init__(self, merges: Merges, known: set[str], cost=lambda c: len(c.encode("utf-8", "surrogatepass"))):
        self.merges, self.known, self.cost = merges, known, cost
        self.fresh()

    def fresh(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.start = self._id(("", (None,), (0,)))

    def _id(self, state: tuple) -> int:
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            self.edges.append({})
        return k

    def _step(self, k: int, c: str) -> tuple[int, int]:
        if c not in self.known:
            return self.start, self.cost(c)
        m = self.merges
        suffix, last, count = self.states[k]
        text = suffix + c
        for i in range(len(text)):
            piece = text[i:]
            if (len(piece) == 1 or piece in m.score and m.reachable(piece)) and (last[i] is None or m.compatible(last[i], piece)):
                token, total = piece, count[i] + 1
                break
        else:  # no neighbour fits: cannot happen for byte-pair encoding
            raise ValueError(f"no token ends after {text!r}")
        last, count = (*last, token), (*count, total)
        while text and text not in m.prefixes:
            text, last, count = text[1:], last[1:], count[1:]
        base = count[-1]
        return self._id((text, last, tuple(x - base for x in count))), total - self.states[k][2][-1]

    def edge(self, k: int, c: str) -> tuple[int, int]:
        if (e := self.edges[k].get(c)) is None:
            e = self.edges[k][c] = self._step(k, c)
        return e

    def run(self, text: str) -> int:
        """Tokens emitted over the whole text from the start state."""
        k, total, edges = self.start, 0, self.edges
        for c in text:
            if (e := edges[k].get(c)) is None:
                e = self.edge(k, c)
            k = e[0]
            total += e[1]
        return total


class ChunkMap:
    """The map of a chunk from the state before it to (state after it, tokens emitted).

    It keeps the run from the start state. Another state is run beside that only until both are in the same state, from
    where they go on alike; where they never meet, to the chunk's end.
    """

    def __init__(self, machine: Transducer, text: str):
        self.machine, self.text, self.states, self.totals = machine, text, [], []
        k, total = machine.start, 0
        for c in text:
            k, n = machine.edge(k, c)
            total += n
            self.states.append(k)
            self.totals.append(total)
        self.exit, self.count = k, total

    def after(self, state: int) -> tuple[int, int]:
        if state == self.machine.start:
            return self.exit, self.count
        total = 0
        for i, c in enumerate(self.text):
            state, n = self.machine.edge(state, c)
            total += n
            if state == self.states[i]:
                return self.exit, total + self.count - self.totals[i]
        return state, total


class Composed:
    """Two neighbouring maps as one."""

    def __init__(self, left: ChunkMap | Composed, right: ChunkMap | Composed):
        self.left, self.right = left, right
        self.exit, n = right.after(left.exit)
        self.count = left.count + n

    def after(self, state: int) -> tuple[int, int]:
        middle, n = self.left.after(state)
        if middle == self.left.exit:
            return self.exit, n + self.count - self.left.count
        end, m = self.right.after(middle)
        return end, n + m


class Counter:
    """Counts of a SentencePiece byte-pair model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        known = {c for p in pieces if len(p) == 1 for c in p}
        self.machine = Transducer(Merges({p: s for p, s in pieces.items() if len(p) > 1}), known)
        self.memo: dict[str, int] = {}

    def _word(self, segment: str) -> int:
        if (n := self.memo.get(segment)) is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            n = self.memo[segment] = self.machine.run(segment)
        return n

    def scan(self, maps: list) -> ChunkMap | Composed:
        """All maps composed, in pairs, level by level."""
        while len(maps) > 1:
            maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        if len(self.machine.states) > STATES:
            self.machine.fresh()
        text = MARK + text.replace(" ", MARK)
        if len(text) <= chunk:  # a word behind marks starts from the start state
            return sum(self._word(x) for x in _SEGMENT.findall(text) if x)
        whole = self.scan([ChunkMap(self.machine, text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return whole.after(self.machine.start)[1]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker and model."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text)."""

    def count(batches):
        machine = counter(model_path)
        for b in slices(batches):
            n = np.fromiter((machine.count(t, chunk) for t in b.column("text").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
