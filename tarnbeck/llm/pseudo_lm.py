"""Masked pseudo-likelihood by a bidirectional window network.

A word's log-probability given its neighbours is that of its class plus that of the word in its class. Class
probabilities come from a network over the classes of the two words before and the two after (SIDE = 2): summed
embeddings by place, tanh, softmax. A document's score is the sum over all its words.

Counts of all words of the corpus are summed in the cluster and joined back to the blocks of text that hold them, so
every word is scored by its own count. The number of classes grows with the logarithm of the number of word types; half
of them hold one of the most frequent words each, the rest share out all other words by frequency (and, where many are
equally frequent, by hash) in about equal parts of the text. Documents are dealt by hash into groups of about
GROUP_WORDS words; each group trains a copy of the network on all its documents, in the order of their hashes and from
the same start. The mean of the copies, weighted by words, is the model. The sums are made in whole numbers, so that
their order doesn't matter, and no step depends on how the input is split.

Null and empty texts have no words and score 0; repeated rows count and score each; extra columns fall away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch, blocks, only
from tarnbeck.llm.grams import Words

WIDTH, SIDE, BATCH, RATE = 24, 2, 4096, 0.05
#: Classes of a small corpus, and further ones for each doubling of its word types; 252 at most, as types are 64-bit hashes.
CLASSES, MORE = 64, 4
#: Bytes of text whose different words are counted and looked up at a time, and words that a training step holds.
TEXT_BYTES, STEP_WORDS = 8_000_000, 300_000
#: Words of a group that trains a copy of the network; their number grows with the corpus.
GROUP_WORDS = 3_000_000
_SCALE = 1 << 20


def _places(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, list[int]]:
    """Hashes of a block's different words, their counts, the places of all its words among them (4 bytes each) and where each text's begin and end."""
    w = Words(buf, offs)
    hashes, ends = w.hashes(), (4 * w.range).tolist()
    del w
    u, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    return u, n, at.astype("<u4").tobytes(), ends


def word_blocks(docs: DataFrame) -> DataFrame:
    """Of each block of texts, its different words (k, word as a hash, n) and its documents (k, doc_id, at: places of their words among those)."""
    schema = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("word", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("at", pa.binary())])

    def cut(batches):
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, j, buf, offs in blocks(b.column("text"), TEXT_BYTES):
                u, n, raw, ends = _places(buf, offs)
                for x in range(0, len(u), 50_000):
                    m = len(u[x : x + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.arange(x, x + m, dtype=np.int32)), pa.array(u[x : x + m].view(np.int64)), pa.array(n[x : x + m].astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=schema)
                own = pa.array([raw[p:q] for p, q in zip(ends[:-1], ends[1:])], pa.binary())
                m = j - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.arange(m, dtype=np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), b.column("doc_id").slice(i, m), own], schema=schema)
                block += 1

    return docs.select("doc_id", "text").mapInArrow(cut, "block long, k int, word long, n long, doc_id long, at binary")


def word_counts(parts: DataFrame) -> DataFrame:
    """block, k, word, n (in the whole corpus), own (once for each word) of every word of every block."""
    every = Window.partitionBy("word")
    rows = parts.where(F.col("at").isNull())
    return rows.select("block", "k", "word", F.sum("n").over(every).alias("n"), (F.min("block").over(every) == F.col("block")).alias("own"))


def _level(n) -> F.Column:
    return F.floor(F.log2(n) * 4).cast("int")


class Lexicon:
    """Classes of all words by their counts; the driver holds a few numbers a class."""

    def __init__(self, counted: DataFrame):
        words = counted.where("own").select("word", "n")
        types = words.count()
        self.classes = max(CLASSES, MORE * types.bit_length())
        self.alone = [(r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(self.classes // 2).collect()]
        rest, left = self.classes - self.classes // 2, words.where(self._rank() == 0) if self.alone else words
        levels = left.groupBy(_level(F.col("n")).alias("level")).agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect()  # 256 rows at most
        size, done = sum(r["n"] for r in levels), 0
        self.low, self.wide = [self.classes // 2] * 256, [1] * 256
        for r in levels:
            low = min(rest - 1, done * rest // size)
            done += r["n"]
            self.low[r["level"]] += low
            self.wide[r["level"]] = max(1, done * rest // size - low)
        self.total = np.zeros(self.classes)
        for r in words.groupBy(self.class_of().alias("cls")).agg(F.sum("n").alias("n")).collect():  # one row a class
            self.total[r["cls"]] = r["n"]
        self.prior = np.log((self.total + 1) / (self.total + 1).sum())

    def _rank(self) -> F.Column:
        """Place of a word among those with a class of their own, from 1; 0 for others."""
        return F.when(F.col("n") >= self.alone[-1][1], F.array_position(F.array(*[F.lit(w).cast("long") for w, _ in self.alone]), F.col("word"))).otherwise(0)

    def class_of(self) -> F.Column:
        numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
        level = _level(F.col("n"))
        shared = F.get(numbers(self.low), level) + F.pmod(F.col("word"), F.get(numbers(self.wide), level)).cast("int")
        return F.when(self._rank() > 0, self._rank().cast("int") - 1).otherwise(shared) if self.alone else shared


def classed(parts: DataFrame, counted: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, cls (a byte a word), inner (sum of its words' log-probabilities in their classes) of every document."""
    total = lexicon.total
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("inner", pa.float64())])

    def look_up(docs: pa.Table, words: pa.Table) -> pa.Table:
        docs = docs.sort_by("k")
        cls, log = np.zeros(len(words), np.uint8), np.zeros(len(words))
        k, c = words.column("k").to_numpy(), words.column("cls").to_numpy()
        cls[k], log[k] = c, np.log(words.column("n").to_numpy()) - np.log(total[c])
        at = [np.frombuffer(x, "<u4") for x in docs.column("at").to_pylist()]
        return pa.table([docs.column("doc_id"), pa.array([cls[x].tobytes() for x in at], pa.binary()), pa.array([float(log[x].sum()) for x in at], pa.float64())], schema=schema)

    docs = parts.where(F.col("at").isNotNull()).select("block", "k", "doc_id", "at")
    words = counted.select("block", "k", "n", lexicon.class_of().alias("cls"))
    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(look_up, "doc_id long, cls binary, inner double")


def steps(batch: pa.RecordBatch | pa.Table):
    """(first row, row after the last, classes, bounds of the rows) of runs of documents of about STEP_WORDS words."""
    own = batch.column("cls").to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in own])]).astype(np.int64)
    i = 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + STEP_WORDS, "right")) - 1)
        yield i, j, np.frombuffer(b"".join(own[i:j]), np.uint8).astype(np.int64), bounds[i : j + 1] - bounds[i]
        i = j


def shapes(classes: int) -> tuple[tuple[int, ...], ...]:
    """Of the embeddings by place (the last class is a place beyond the text's ends), of the output weights and biases."""
    return (2 * SIDE, classes + 1, WIDTH), (WIDTH, classes), (classes,)


def start(prior: np.ndarray) -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    return [(rng.standard_normal(s) * 0.1).astype(np.float32) for s in shapes(len(prior))[:2]] + [prior.astype(np.float32)]


def contexts(cls: np.ndarray, at: np.ndarray, edge: int) -> np.ndarray:
    """Per word, the classes of its neighbours: SIDE before, SIDE after; edge beyond the text's ends."""
    n = len(cls)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.full((n, 2 * SIDE), edge)
    for k, away in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        place = np.arange(n) + away
        ok = (place >= at[:-1][doc]) & (place < at[1:][doc])
        out[ok, k] = cls[place[ok]]
    return out


def forward(model: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    emb, out, bias = model
    hidden = emb[0][around[:, 0]]
    for k in range(1, 2 * SIDE):
        hidden = hidden + emb[k][around[:, k]]
    hidden = np.tanh(hidden)
    logits = hidden @ out + bias
    logits -= logits.max(axis=1, keepdims=True)
    return hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def learn(model: list[np.ndarray], around: np.ndarray, cls: np.ndarray) -> None:
    """One step of gradient descent on each BATCH words."""
    emb, out, bias = model
    for i in range(0, len(cls), BATCH):
        a, y = around[i : i + BATCH], cls[i : i + BATCH]
        hidden, logs = forward(model, a)
        g = np.exp(logs)
        g[np.arange(len(y)), y] -= 1
        g *= np.float32(1 / len(y))
        back = (g @ out.T) * (1 - hidden * hidden)
        out -= np.float32(RATE * 8) * (hidden.T @ g)
        bias -= np.float32(RATE * 8) * g.sum(axis=0)
        for k in range(2 * SIDE):
            one = np.zeros((len(y), len(bias) + 1), np.float32)
            one[np.arange(len(y)), a[:, k]] = 1
            emb[k] -= np.float32(RATE * 160) * (one.T @ back)


def _trained(docs: DataFrame, prior: np.ndarray, words: int) -> list[np.ndarray]:
    sizes = [int(np.prod(s)) for s in shapes(len(prior))]
    size = sum(sizes)

    def train(group: pa.Table) -> pa.Table:
        model, seen = start(prior), 0
        group = group.sort_by([("order", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        for _, _, cls, at in steps(group):
            learn(model, contexts(cls, at, len(prior)), cls)
            seen += len(cls)
        flat = np.concatenate([m.ravel() for m in model]).astype(float)
        return pa.table([pa.array(np.arange(size)), pa.array(np.rint(flat * _SCALE).astype(np.int64)), pa.array(np.full(size, seen))], ["i", "v", "n"])

    order = F.xxhash64("doc_id", "cls")
    dealt = docs.where(F.length("cls") > 0).select("doc_id", "cls", order.alias("order"), F.pmod(order, F.lit(max(1, words // GROUP_WORDS))).alias("part"))
    parts = dealt.groupBy("part").applyInArrow(train, "i long, v long, n long")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = parts.groupBy("i").agg(exact(F.col("v") * F.col("n").cast("decimal(18,0)")).alias("v"), exact(F.col("n")).alias("n")).collect()  # one row a weight
    if not rows:
        return start(prior)
    flat = np.zeros(size, np.float32)
    for r in rows:
        flat[r["i"]] = float(r["v"] / r["n"]) / _SCALE
    return [p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes(len(prior)))]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over its words), per_word for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = scratch.keep(word_blocks(rows), "word-blocks")
    counted = scratch.keep(word_counts(parts), "word-counts")
    lexicon = Lexicon(counted)
    known = scratch.keep(classed(parts, counted, lexicon), "classed")
    scratch.drop(parts, counted)
    prior = lexicon.prior
    model = _trained(known, prior, int(lexicon.total.sum()))

    def judge(batches):
        for b in batches:
            for i, j, cls, at in steps(b):
                around, logs = contexts(cls, at, len(prior)), np.empty(len(cls))
                for k in range(0, len(cls), BATCH):
                    _, out = forward(model, around[k : k + BATCH])
                    logs[k : k + BATCH] = out[np.arange(len(out)), cls[k : k + BATCH]]
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                total = sums[at[1:]] - sums[at[:-1]] + b.column("inner").slice(i, j - i).to_numpy()
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(np.round(total, 6)), pa.array(np.round(total / np.maximum(n, 1), 6))], ["doc_id", "n_words", "log_likelihood", "per_word"])

    return known.mapInArrow(judge, "doc_id long, n_words long, log_likelihood double, per_word double")
