"""Quality rules whose cutoffs are certified on labelled holdouts.

Every rule is a share of a text (symbols, capitals, exclamation marks, repeated lines); a document is
rejected if a share exceeds the rule's cutoff for its stratum (its language). A cutoff is admissible if the exact
binomial (Clopper-Pearson) upper bound of the share of good labelled documents that it rejects stays below the
rule's part of the allowed risk. The confidence is divided by the number of all (stratum, rule, cutoff) tests
(Bonferroni), so all bounds hold together; each rule then takes its tightest admissible cutoff, and the parts of the
risk add up to at most `risk` per stratum. A rule without an admissible cutoff rejects nothing.

Nulls count as empty texts (which fail the base rule), a null language is a stratum of its own, labels without a
document or without a quality are ignored, several labels of one document count as its worst; repeated rows are
judged each. Without labels only the base rule rejects. Extra columns fall away from the digest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch, blocks, only
from tarnbeck.llm.grams import Words, per_text, shingles

RULES = ("symbols", "capitals", "bangs", "dup_lines")
#: Candidate cutoffs of every rule.
GRID = (0.05, 0.1, 0.15, 0.2, 0.25, 0.35, 0.5, 0.7)
RISK, CONFIDENCE = 0.01, 0.05
#: Strata whose cutoffs are broadcast at most (a few numbers each); more are joined by a shuffle.
BROADCAST_ROWS = 10_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs", "n_lines")
_BLANK = " \t\n\v\f\r"


def _repeats(words: Words) -> np.ndarray:
    """Per text, the words in five-word windows that the text holds twice or more."""
    grams, bounds = shingles(words, 5, fold=False, short=False)
    out = np.zeros(len(bounds) - 1, np.int64)
    for d in np.flatnonzero(np.diff(bounds) > 1):
        own = grams[bounds[d] : bounds[d + 1]]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(own) + 5, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            out[d] = np.count_nonzero(np.cumsum(edge))
    return out


def _dup_lines(text: str) -> tuple[int, int]:
    lines = text.split("\n")
    seen: set[str] = set()
    n = dup = 0
    for line in lines:
        if line.strip(_BLANK):
            n += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return dup, n


def measure(column: pa.Array) -> list[np.ndarray]:
    """_NAMES of every text."""
    parts: list[list[np.ndarray]] = []
    for i, j, buf, offs in blocks(column):
        w = Words(buf, offs)
        chars = per_text(w.inside & ((buf & 0xC0) != 0x80), offs)
        lines = np.array([_dup_lines(t or "") for t in column.slice(i, j - i).to_pylist()], np.int64).reshape(-1, 2)
        parts.append([w.count.astype(np.int64), chars, per_text(_SYMBOL[buf], offs), lines[:, 0], _repeats(w), per_text((buf >= 65) & (buf <= 90), offs), per_text(buf == 33, offs), lines[:, 1]])
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(_NAMES)


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and `_q_` measures of every row."""

    def add(batches):
        for b in batches:
            values = measure(b.column("_q_text"))
            own = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_q_text"]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, values)], [*[n for n in b.schema.names if n != "_q_text"], *[f"_q_{n}" for n in _NAMES]])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("_q_text"))
    kept = rows.drop("_q_text").schema
    for n in _NAMES:
        kept = kept.add(f"_q_{n}", "long")
    return rows.mapInArrow(add, kept)


def shares() -> dict[str, F.Column]:
    """Each rule's value, from the measures."""
    q = {n: F.col(f"_q_{n}").cast("double") for n in _NAMES}
    over = lambda a, b: F.coalesce(q[a] / F.nullif(q[b], F.lit(0.0)), F.lit(0.0))
    return {"symbols": over("n_symbols", "word_chars"), "capitals": over("n_capitals", "word_chars"), "bangs": over("n_bangs", "n_words"), "dup_lines": over("n_dup_lines", "n_lines")}


def base_failed() -> F.Column:
    return (F.col("_q_n_words") < 10) | (100 * F.col("_q_n_repeat_words") > 20 * F.col("_q_n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(at most k of n)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def admissible(k: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact upper bound at `level` of a rejection rate seen as k of n stays at or below risk."""
    return n > 0 and k <= risk * n and binomial_cdf(k, n, risk) <= level


def cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """_q_lang and _q_cut_<rule> (infinite if none is admissible) of every stratum with labels.

    Of documents that pass the base rule and are labelled good. Counts are summed in the cluster, a row for each
    stratum; only the number of strata, which divides the confidence, comes to the driver.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_q_id")).agg(F.min("quality").alias("_q_good"))
    held = features.where(~base_failed()).join(good.where("_q_good = 1").select("_q_id"), F.col("doc_id") == F.col("_q_id"))
    sums = [F.sum((v > F.lit(c)).cast("long")).alias(f"{r}_{round(100 * c)}") for r, v in shares().items() for c in GRID]
    rows = Scratch(features.sparkSession).keep(held.groupBy(stratum().alias("_q_lang")).agg(F.count(F.lit(1)).alias("n"), *sums), "label-counts")
    tests = max(1, rows.count()) * len(RULES) * len(GRID)

    def choose(batches):
        for b in batches:
            own = {name: b.column(name).to_pylist() for name in b.schema.names}
            cuts = [[next((c for c in GRID if admissible(own[f"{r}_{round(100 * c)}"][i], own["n"][i], risk / len(RULES), confidence / tests)), math.inf) for i in range(b.num_rows)] for r in RULES]
            yield pa.RecordBatch.from_arrays([b.column("_q_lang"), *[pa.array(c, pa.float64()) for c in cuts]], ["_q_lang", *[f"_q_cut_{r}" for r in RULES]])

    return Scratch(features.sparkSession).keep(rows.mapInArrow(choose, "_q_lang string, " + ", ".join(f"_q_cut_{r} double" for r in RULES)), "cutoffs")


def stratum() -> F.Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("?"))


def judged(features: DataFrame, cuts: DataFrame) -> DataFrame:
    """features with _q_kept: true unless the base rule or a share above its stratum's cutoff rejects."""
    few = cuts.count() <= BROADCAST_ROWS
    both = features.withColumn("_q_lang", stratum()).join(F.broadcast(cuts) if few else cuts, "_q_lang", "left")
    rejected = F.lit(False)
    for rule, value in shares().items():
        rejected = rejected | F.coalesce(value > F.col(f"_q_cut_{rule}"), F.lit(False))
    return both.withColumn("_q_kept", ~base_failed() & ~rejected)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    features = Scratch(docs.sparkSession).keep(measured(only(docs, "doc_id", "lang", "text"), ["doc_id", "lang"]), "quality")
    out = judged(features, cutoffs(features, labels, risk))
    return out.select(F.col("doc_id").cast("long"), *[F.col(f"_q_{n}").alias(n) for n in _NAMES[:5]], base_failed().alias("base_failed"), F.col("_q_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """The rows of docs, all columns, that the rules keep. Texts are measured once and written with their measures."""
    features = Scratch(docs.sparkSession).keep(measured(docs, docs.columns), "quality")
    return judged(features, cutoffs(features, labels, risk)).where("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
