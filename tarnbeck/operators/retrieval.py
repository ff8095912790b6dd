"""Search over a document table: columns id, kind, as_of, body (and whatever else is carried)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.functions.shared import spread


def compiled(terms: list[str]) -> list[str]:
    """The terms, if each is a regular expression; one that isn't is named, as a silent miss would read as no evidence."""
    for term in terms:
        try:
            re.compile(term)
        except re.error as e:
            raise ValueError(f"invalid term {term!r}: {e}") from e
    return terms


def matched_terms(docs: DataFrame, terms: list[str], kinds: list[str] | None = None) -> DataFrame:
    """docs with `matched`, the number of different terms (regular expressions, any case) that the body holds.

    Terms are matched line by line, with ^ and $ at the ends of lines. A fixed term list becomes flags within one scan:
    no join, and the kind filter reaches the files.
    """
    rows = docs.where(F.col("kind").isin(kinds)) if kinds else docs
    flags = [F.col("body").rlike(f"(?im){t}").cast("long") for t in compiled(list(dict.fromkeys(terms)))]
    return rows.withColumn("matched", sum(flags[1:], flags[0])).where("matched > 0")


def search(docs: DataFrame, terms: list[str], top_k: int, kinds: list[str] | None = None, context: int = 1) -> DataFrame:
    """The top_k documents by most terms, newest, id, with the first matching line and its neighbours."""
    hits = matched_terms(docs, terms, kinds).orderBy(F.desc("matched"), F.desc("as_of"), F.asc("id")).limit(top_k)
    lines = F.split("body", "\n")
    any_term = "(?i)" + "|".join(f"(?:{t})" for t in terms)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(any_term)), True)
    start = F.greatest(first - context, F.lit(1)).cast("int")
    stop = F.least(first + context, F.size(lines)).cast("int")
    return hits.select("id", "kind", "as_of", "matched", first.cast("long").alias("line"), F.array_join(F.slice(lines, start, stop - start + 1), "\n").alias("excerpt"))


def manifest(docs: DataFrame) -> DataFrame:
    return docs.select("id", "kind", "as_of", F.octet_length("body").cast("long").alias("bytes"), T.one_line(F.col("body")).alias("summary"))


#: Up to so many bytes of terms, the terms are sent to the documents and not the documents' words to them.
SENT = 32 << 20


def matches_per_question(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, n (its different terms), id, as_of, matched (those that the document holds) where there is one.

    questions have qid and an array of terms. A term (three characters or more, no white space) is held if a word
    contains it, a dot in it standing for any character. Terms meet words in an equi-join on three characters of
    both, without a dot where there are such (documents without an id are left out). One shuffle by document then serves
    for the different terms of it and for the counts.
    """
    asked = questions.select("qid", F.size(F.array_distinct("terms")).cast("long").alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    words = spread(docs.where("id is not null").select("id", "as_of", "body")).select("id", "as_of", F.explode(F.array_distinct(F.split(F.lower("body"), r"\s+"))).alias("word"))
    threes = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3)))
    terms = asked.select("term").distinct()
    # Terms whose runs between dots are all shorter than three characters are matched on every word; there are few.
    whole = F.get(F.filter(threes(F.col("term")), lambda x: ~F.contains(x, F.lit("."))), F.lit(0))
    keyed = terms.withColumn("k", whole)
    size, n_dotted = keyed.agg(F.sum(F.octet_length("term") + 64), F.count(F.when(F.col("k").isNull(), 1))).first()
    sent = (size or 0) <= SENT
    # Sent terms meet each document's words; else the vocabulary meets them first and the pairs meet the words.
    looked, own = (words, ["id", "as_of"]) if sent else (words.select("word").distinct(), ["word"])
    side = F.broadcast if sent else (lambda df: df)
    holds = F.expr("CASE WHEN contains(term, '.') THEN regexp_like(word, term) ELSE contains(word, term) END")
    by_key = looked.select("*", F.explode(F.array_distinct(threes(F.col("word")))).alias("k"))
    met = by_key.join(side(keyed.where("k is not null")), "k").where(holds).select(*own, "term")
    if n_dotted:
        dotted = keyed.where("k is null").select("term", F.length("term").alias("n"))
        by_length = looked.select("*", F.explode(F.sequence(F.lit(3), F.greatest(F.length("word"), F.lit(3)))).alias("n"))
        met = met.union(by_length.join(side(dotted), "n").where(holds).select(*own, "term"))
    held = (met if sent else words.join(met.distinct(), "word")).select("id", "as_of", "term").repartition("id").distinct()
    return held.join(asked, "term").groupBy("qid", "n", "id", "as_of").agg(F.count(F.lit(1)).alias("matched"))


def best_matches(matches: DataFrame, k: int) -> DataFrame:
    """The k best documents of every question by terms that they hold, newest, id."""
    best = Window.partitionBy("qid").orderBy(F.desc("matched"), F.desc("as_of"), F.asc("id"))
    return matches.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def ranked_per_question(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    return best_matches(matches_per_question(docs, questions), k)


def holders(matches: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """qid, id of the documents that hold the whole text of an item (qid, item): of those with all its terms, the exact test.

    Terms of an item are runs of ASCII characters of it, so that a document with its text holds them all. Items without
    terms aren't found here.
    """
    near = matches.where("matched = n").select("qid", "id").join(items, "qid")
    return near.join(docs.select("id", "body"), "id").where(F.contains("body", "item")).select("qid", "id").distinct()


def recall(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question of gold (qid, id): its gold documents and the share of them that were ranked."""
    hits = gold.join(ranked.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 4).alias("recall"))
