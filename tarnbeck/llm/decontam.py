"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

Texts are lists of five-word shingles (words lower-cased; with fewer words, the whole as one). A window has as
many shingles as the item, at any place of the document (a shorter document is one window). A document is leaked an
item if a window's shingles, weighted by how often they occur, have weighted Jaccard similarity with the item's of at
least `share`.

1. A match shares at least ceil(share * size) of the item's shingles, so one of its size - ceil(share * size) + 1
   rarest is among them (those that the fewest items have). Documents and items that share one are looked at; a
   shingle that all items have brings none together.
2. Windows with at least ceil(share * size) places that hold a shingle of the item get 64-bit SimHash fingerprints: a
   shingle votes on every bit. Votes are summed along the places that such windows hold once (32-bit counters, two in
   a long), and a window is the difference of two sums, so a long item costs no more than its document.
3. Multi-index: fingerprints within `radius` of each other agree in one of radius + 1 blocks of bits, so joining the
   blocks of windows and items by item, block and value finds all of them; the Hamming distance is then checked.
4. Candidates are verified by exact weighted similarity. A place counts for the windows that hold it, but not those
   that hold as many earlier places of its shingle as the item has: an interval of starts. Intervals are swept once
   per document and item.

Fingerprints of windows at similarity 0.75 differ in 11 of 64 bits on average, with a standard deviation of 3: at
radius 20, 2 in 1,000 of such borderline windows escape, and none in practice from 0.85 on. Null and empty texts (of
documents or items) leak nothing; repeated rows are judged each; items and documents of any length are taken whole;
extra columns fall away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.llm.common import WORD_SPACE, Scratch, numbered

K, SHARE, RADIUS = 5, (75, 100), 20
#: Item shingles that are broadcast at most (16 bytes each); a larger benchmark is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Longs that hold the counters of a fingerprint's 64 bits.
LONGS = 32


def shingle_hashes(text: Column) -> Column:
    """The hashes of a text's shingles in order. The words are bound to a lambda's name, so they are split once."""
    words = F.transform(F.filter(F.split(F.lower(text), WORD_SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    some = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.xxhash64(F.slice(w, i, K)))
    every = lambda w: F.when(F.size(w) >= K, some(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(words), every), 1)


def with_shingles(rows: DataFrame) -> DataFrame:
    """rows with `shingles`, and `text` gone."""
    return rows.withColumn("shingles", shingle_hashes(F.coalesce(F.col("text").cast("string"), F.lit("")))).drop("text")


def votes(h: Column) -> list[Column]:
    """LONGS longs with a 32-bit counter for each of two bits of the hash."""
    bit = lambda i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1))
    return [bit(2 * j).bitwiseOR(F.shiftleft(bit(2 * j + 1), 32)) for j in range(LONGS)]


def fingerprint(sums: list[Column], n: Column) -> Column:
    """Bits with a majority of the n votes."""
    out = F.lit(0).cast("long")
    for j, s in enumerate(sums):
        for i in range(2):
            count = F.shiftrightunsigned(s, 32 * i).bitwiseAND(F.lit((1 << 32) - 1))
            out = out.bitwiseOR(F.shiftleft((count * 2 > n).cast("long"), 2 * j + i))
    return out


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 structs (block, value) that cover the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def least_common(size: Column, share: tuple[int, int]) -> Column:
    return F.ceil(size * share[0] / F.lit(share[1]))


def seed_shingles(of_item: DataFrame, items: DataFrame, share: tuple[int, int]) -> DataFrame:
    """item, h: of each item its rarest shingles, one of which every match has."""
    rare = of_item.groupBy("h").agg(F.count(F.lit(1)).alias("in_items"))
    ranked = of_item.join(rare, "h").join(items.select("item", "size"), "item")
    before = F.sum("in_item").over(Window.partitionBy("item").orderBy("in_items", "h")) - F.col("in_item")
    # The shingles before this one may all be missing from a match.
    return ranked.withColumn("before", before).where(F.col("before") <= F.col("size") - least_common(F.col("size"), share)).select("item", "h")


def windows_at(hits: DataFrame, share: tuple[int, int]) -> DataFrame:
    """rid, item, size, count, start, common of the windows with enough places of the item; hits: rid, item, pos, h,
    in_item, size, count of every place."""
    key = ["rid", "item"]
    numbered_hits = hits.withColumn("r", F.row_number().over(Window.partitionBy(*key, "h").orderBy("pos")))
    same = numbered_hits.select(*key, "h", F.col("pos").alias("full"), (F.col("r") + F.col("in_item")).alias("r"))
    placed = numbered_hits.join(same, [*key, "h", "r"], "left")
    low = F.greatest(F.col("pos") - F.col("size") + 1, F.lit(0))
    high = F.least(F.col("pos"), F.greatest(F.col("count") - F.col("size"), F.lit(0)))
    counts = F.greatest(low, F.coalesce(F.col("full") + 1, F.lit(0)))
    step = lambda at, places, common: F.struct(at.cast("long").alias("at"), F.lit(places).alias("places"), common.alias("common"))
    ends = F.when(counts <= high, F.lit(-1)).otherwise(F.lit(0))
    steps = F.array(step(low, 1, F.lit(0)), step(counts, 0, -ends), step(high + 1, -1, ends))
    swept = placed.where(low <= high).select(*key, "size", "count", F.explode(steps).alias("s")).groupBy(*key, "size", "count", "s.at").agg(F.sum("s.places").alias("places"), F.sum("s.common").alias("common"))
    along = Window.partitionBy(*key).orderBy("at")
    runs = swept.select(*key, "size", "count", "at", F.lead("at").over(along).alias("next"), F.sum("places").over(along).alias("places"), F.sum("common").over(along).alias("common"))
    full = runs.where(F.col("next").isNotNull() & (F.col("places") >= least_common(F.col("size"), share)))
    return full.select(*key, "size", "count", F.explode(F.sequence("at", F.col("next") - 1)).alias("start"), "common")


def vote_sums(places: DataFrame, windows: DataFrame) -> DataFrame:
    """rid, at, v0 and so on: the votes before each start and end of a window, from the places inside windows alone.

    Starts and ends are rows among the places, so that one order of a document gives what is open and what was summed.
    Only hashes are shuffled; their counters are spread out after it, and the places go before the sums are written.
    """
    mark = lambda at, opens: F.struct(F.col(at).alias("at"), F.lit(opens).alias("opens"))
    marks = windows.select("rid", F.explode(F.array(mark("start", 1), mark("end", -1))).alias("m")).groupBy("rid", "m.at").agg(F.sum("m.opens").alias("opens"))
    marks = marks.select("rid", "at", F.lit(False).alias("place"), "opens", F.lit(None).cast("long").alias("h"))
    points = places.select("rid", F.col("pos").cast("long").alias("at"), F.lit(True).alias("place"), F.lit(0).cast("long").alias("opens"), "h").union(marks)
    along = Window.partitionBy("rid").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = points.repartition("rid").withColumn("open", F.sum("opens").over(along)).where(~F.col("place") | (F.col("open") > 0))
    counters = [F.coalesce(v, F.lit(0).cast("long")).alias(f"v{j}") for j, v in enumerate(votes(F.col("h")))]
    sums = covered.select("rid", "at", "place", *counters).select("rid", "at", "place", *[F.sum(f"v{j}").over(along).alias(f"v{j}") for j in range(LONGS)])
    return sums.where(~F.col("place")).drop("place")


def leaks(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = SHARE, radius: int = RADIUS) -> DataFrame:
    """rid (of numbered docs), doc_id, item_id, start (first best window's shingle), common, total (weighted
    shingles in both, in either) of every leaked item."""
    scratch = Scratch(docs.sparkSession)
    items = with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")).where(F.size("shingles") > 0)
    items = scratch.keep(items.withColumn("item", F.monotonically_increasing_id()), "items").withColumn("size", F.size("shingles").cast("long"))
    item_rows = items.select("item", F.explode("shingles").alias("h"))
    of_item = scratch.keep(item_rows.groupBy("item", "h").agg(F.count(F.lit(1)).alias("in_item")), "item-shingles")
    seeds = scratch.keep(seed_shingles(of_item, items, share), "seeds")
    few = of_item.count() <= BROADCAST_ROWS
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Outer, as a plain explode makes Spark add a filter that reckons the shingles once more.
    at = with_shingles(rows).select("rid", F.explode_outer("shingles").alias("h"))
    pairs = scratch.keep(at.join(F.broadcast(seeds) if few else seeds, "h").select("rid", "item").distinct(), "pairs")
    # The texts move, not their shingles, at every size in the same way.
    some = with_shingles(rows.select("rid", "text").join(pairs.select("rid").distinct().hint("merge"), "rid"))
    places = scratch.keep(some.select("rid", F.size("shingles").cast("long").alias("count"), F.posexplode_outer("shingles").alias("pos", "h")), "places")
    own = of_item.join(items.select("item", "size"), "item")
    hits = places.join(pairs, "rid").join(F.broadcast(own) if few else own, ["item", "h"])
    found = scratch.keep(windows_at(hits, share), "windows")
    windows = found.withColumn("n", F.least("size", "count")).withColumn("end", F.col("start") + F.col("n"))
    sums = scratch.keep(vote_sums(places, windows), "vote-sums")
    begin = sums.select("rid", F.col("at").alias("start"), *[F.col(f"v{j}").alias(f"b{j}") for j in range(LONGS)])
    spans = windows.join(sums.withColumnRenamed("at", "end"), ["rid", "end"]).join(begin, ["rid", "start"])
    inside = [F.col(f"v{j}") - F.col(f"b{j}") for j in range(LONGS)]
    # Written, so that the long expression of a fingerprint isn't copied into each of its uses.
    prints = scratch.keep(spans.select("rid", "item", "start", "n", "size", "common", fingerprint(inside, F.col("n")).alias("fp")), "prints")
    item_sums = item_rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"v{j}") for j, v in enumerate(votes(F.col("h")))])
    item_prints = scratch.keep(item_sums.select("item", fingerprint([F.col(f"v{j}") for j in range(LONGS)], F.col("n")).alias("item_fp")), "item-prints")
    item_blocks = item_prints.select("item", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b")).select("item", "item_fp", "b.*")
    window_blocks = prints.select("*", F.explode(blocks(F.col("fp"), radius)).alias("b")).select(*prints.columns, "b.*")
    near = window_blocks.join(item_blocks, ["item", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    total = F.col("n") + F.col("size") - F.col("common")
    true = near.where(F.col("common") * share[1] >= total * share[0]).select("rid", "item", "start", "common", total.alias("total"))
    # Of one document and item, windows differ in `total` by `common` alone: the most common is the most similar.
    best = scratch.keep(true.groupBy("rid", "item").agg(F.max(F.struct(F.col("common"), (-F.col("start")).alias("back"), F.col("total"))).alias("b")), "best")
    scratch.drop(pairs, places, found, sums, prints)
    named = best.join(items.select("item", "item_id"), "item").join(rows.select("rid", "doc_id"), "rid")
    return named.select("rid", "doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start"), F.col("b.common").alias("common"), F.col("b.total").alias("total"))


def leaked_items(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = SHARE, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start, common, total of every leaked item."""
    return leaks(numbered(docs, "doc_id", "text"), benchmark, share, radius).drop("rid")


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = SHARE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, in which no item is leaked."""
    rows = numbered(docs, name="_tb_rid")
    bad = leaks(rows.select(F.col("_tb_rid").alias("rid"), "doc_id", "text"), benchmark, share, radius).select(F.col("rid").alias("_tb_rid")).distinct()
    bad = Scratch(docs.sparkSession).keep(bad, "leaked")
    return rows.join(bad, "_tb_rid", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql_shingles(table: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN len(w) >= {K} THEN list_transform(generate_series(1, len(w) - {K - 1}), lambda i: array_to_string(w[i:i + {K - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""


ORACLE = f"""
WITH items AS ({_sql_shingles("benchmark", "item_id")}), docs AS ({_sql_shingles("documents", "doc_id")}),
ir AS (SELECT item_id, len(s) AS size, unnest(s) AS h FROM items),
ic AS (SELECT item_id, size, h, count(*) AS n FROM ir GROUP BY ALL),
dr AS (SELECT doc_id, len(s) AS cnt, unnest(s) AS h, generate_subscripts(s, 1) - 1 AS pos FROM docs),
hits AS (SELECT doc_id, item_id, size, cnt, pos FROM dr JOIN ic USING (h)),
wins AS (SELECT DISTINCT doc_id, item_id, size, unnest(generate_series(greatest(pos - size + 1, 0), least(pos, greatest(cnt - size, 0)))) AS start FROM hits),
ws AS (SELECT w.doc_id, w.item_id, w.size, w.start, d.h, count(*) AS n FROM wins w JOIN dr d ON d.doc_id = w.doc_id AND d.pos >= w.start AND d.pos < w.start + w.size GROUP BY ALL),
sims AS (SELECT ws.doc_id, ws.item_id, ws.start, max(ws.size) AS size, sum(ws.n) AS wn, sum(least(ws.n, coalesce(ic.n, 0))) AS common FROM ws LEFT JOIN ic ON ic.item_id = ws.item_id AND ic.h = ws.h GROUP BY ALL),
ok AS (SELECT doc_id, item_id, start, cast(common AS BIGINT) AS common, cast(wn + size - common AS BIGINT) AS total FROM sims WHERE common * {SHARE[1]} >= (wn + size - common) * {SHARE[0]})
SELECT doc_id, item_id, cast(start AS BIGINT) AS start, common, total FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common DESC, start) = 1"""
