"""Removal of near-duplicate lines by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its words. A line is removed if an earlier line (by doc_id, row, place) has
Jaccard similarity of at least `share` with it. Lines with fewer than `least` different words are never removed;
the digest has no such floor, so that lines without words alone are exempt.

1. Word counts of the whole corpus, in BUCKETS counters, order each line's words by rarity.
2. Lines with equal sets become one class by a partial aggregation; all but its first line go. Classes are numbered in
   the order of their first lines, so that a smaller number is an earlier line.
3. Two classes at `share` have a common word among their rarest n - ceil(share * n) + 1 (prefix filter); set sizes
   (length filter), the place of that word (positional filter) and 64 parities of the words' hashes leave room for
   enough common words. Sets differ in at least as many words as their parities do, so none of these drops a match.
   64 parities tell nothing of sets of 200 words; from LONG words on there are 256.
4. Every class is first held against the earliest class that shares its prefix word: one pair for each prefix word at
   most. A group of near-equal lines is resolved by that, and a word of two classes is settled for good.
5. A class that found no match so far is held against all others of its words by semi joins, which look for one
   earlier match and make no pairs. A word of more than HOT classes is joined with a second one: matches that have
   their first common word there share another one of their rarest n - ceil(share * n) + 2.
6. Similarities are reckoned on full sets, for the pairs of 4 and then for the classes that 5 leaves and their partners.
   A class's partners are looked for by all of 3 at once: the other classes of its words aren't listed.

Null texts have one empty line; they and null ids keep their row. Repeated rows are documents of their own, the first
of them being the earlier. Lines of any length are read whole. Extra columns are kept by `drop_repeated_lines` and fall
away from the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch, numbered

SHARE, LEAST = (85, 100), 5
#: Counters of the rarity order, a power of two: a fixed number, so that the table that every task holds doesn't grow.
BUCKETS = 1 << 17
#: What a join of classes needs of each: number, size, place of the word, parities, more of them for long lines.
OWN = ("id", "n", "i", "odd", "fine")
#: Bits below a word's rarity class (5 bits) in its key: the low ones of its hash.
LOW = 58
#: Rarity class from which on a word's classes are split for the search of its earliest class: below, a word has fewer
#: than 2 ** SPLIT places in the corpus.
SPLIT = 20
#: Classes of a word from which on it is joined together with a second word.
HOT = 1000
#: Words of a line from which on its parities are counted in 256 parts.
LONG = 128
#: Open classes' words that are broadcast at most (some 60 bytes each) to find their partners; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def spaced(text: Column) -> Column:
    """With a space for all other white space but line ends, so that words split at single spaces."""
    blanks = ("\t", "\x0b", "\x0c", "\r")
    some = F.contains(text, F.lit(blanks[0]))
    for b in blanks[1:]:
        some = some | F.contains(text, F.lit(b))
    return F.when(some, F.regexp_replace(text, "[\\x09\\x0B-\\x0D]", " ")).otherwise(text)


def word_hashes(line: Column) -> Column:
    """Hashes of the words of a spaced line, repeated ones and those of empty words too."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def once(value: Column) -> Column:
    """The value, reckoned once however often it is used. Outer, as a plain explode makes Spark reckon it once more."""
    return F.explode_outer(F.array(value))


def rarity(rows: DataFrame) -> Column:
    """The rarity class of each counter: the logarithm of how many words it has counted. One text of a few hundred
    kilobytes comes to the driver and goes into the plan, whatever the corpus."""
    words = rows.select(F.explode_outer(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select(F.concat_ws(" ", "k", F.least(F.lit(31), F.length(F.bin("n")))).alias("x"))
    level = [0] * BUCKETS
    for pair in (levels.agg(F.array_join(F.collect_list("x"), ",")).first()[0] or "").split(","):  # BUCKETS pairs
        if pair:
            k, n = pair.split(" ")
            level[int(k)] = int(n)
    return F.split(F.lit(",".join(map(str, level))), ",").cast("array<bigint>")


def prefix_size(n: Column, share: tuple[int, int]) -> Column:
    return n - F.ceil(n * share[0] / F.lit(share[1])).cast("int") + 1


def need(share: tuple[int, int]) -> Column:
    """Common words that classes a and b need at least."""
    return F.ceil((F.col("a_n") + F.col("b_n")) * share[0] / F.lit(share[0] + share[1]))


def may_match(share: tuple[int, int]) -> Column:
    """Length, positional and parity filter of two classes at a common word."""
    sizes = F.least("a_n", "b_n") * share[1] >= F.greatest("a_n", "b_n") * share[0]
    # The first common word of a match has no common one before it: what follows bounds the rest.
    rest = F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i")) >= need(share)
    differ = F.col("a_n") + F.col("b_n") - 2 * need(share)
    odd = F.col("a_odd").bitwiseXOR(F.col("b_odd"))
    parts = [F.get("a_fine", F.lit(k)).bitwiseXOR(F.get("b_fine", F.lit(k))) for k in range(3)]
    fine = sum(map(F.bit_count, parts), F.bit_count(odd.bitwiseXOR(parts[0]).bitwiseXOR(parts[1]).bitwiseXOR(parts[2])))
    return sizes & (F.bit_count(odd) <= differ) & rest & F.coalesce(fine <= differ, F.lit(True))


def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.select("w", *[F.col(c).alias(f"{name}_{c}") for c in columns])


def line_sets(rows: DataFrame, level: Column, least: int, share: tuple[int, int]) -> DataFrame:
    """rid, doc_id, pos, n, d1, d2 (digest), odd (parities), fine (three of the four parts of `odd`, null for lines of
    fewer than LONG words) and head (rarest words) of every line of `least` words or more."""
    # A word is its rarity class, then the low bits of its hash: sorting puts rare words first.
    key = lambda h: F.shiftleft(F.coalesce(F.get(level, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0)), LOW).bitwiseOR(h.bitwiseAND(F.lit((1 << LOW) - 1)))
    blank = key(F.xxhash64(F.lit("")))
    lines = rows.select("rid", "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    words = F.array_remove(F.array_distinct(F.sort_array(F.transform(word_hashes(F.col("line")), key))), blank)
    sets = lines.select("rid", "doc_id", "pos", once(words).alias("words")).where(F.size("words") >= least)
    parity = lambda odd, w: odd.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int")))
    n = F.size("words")
    # Unequal sets of so few words are never at `share`: n / (n + 1) is the best that n words can reach.
    joins = n * share[1] >= (n + 1) * share[0]
    head = F.when(joins, F.slice("words", 1, prefix_size(n, share) + 1))
    odd = F.when(joins, F.aggregate("words", F.lit(0).cast("long"), parity))
    part = lambda k: F.filter("words", lambda w: F.shiftrightunsigned(w, 6).bitwiseAND(F.lit(3)) == k)
    fine = F.when(joins & (n >= LONG), F.array(*[F.aggregate(part(k), F.lit(0).cast("long"), parity) for k in range(3)]))
    return sets.select("rid", "doc_id", "pos", n.alias("n"), F.xxhash64("words").alias("d1"), F.xxhash64(F.lit(7), "words").alias("d2"), odd.alias("odd"), fine.alias("fine"), head.alias("head"))


def numbered_classes(lines: DataFrame) -> DataFrame:
    """id (in the order of `first`), d1, d2, first (place), copies, n, odd, fine, head of every class of equal sets."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "pos")
    kinds = lines.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("fine").alias("fine"), F.first("head").alias("head"))
    return kinds.repartitionByRange("first").sortWithinPartitions("first").withColumn("id", F.monotonically_increasing_id())


def with_earliest(kinds: DataFrame, share: tuple[int, int]) -> DataFrame:
    """w, id, n, i, odd, fine of every class and prefix word that has (or, for a split word, may have) company; near: its classes, in
    its part of a split word; p_id and so on: the earliest of them."""
    heads = kinds.where(F.col("head").isNotNull()).select("id", "n", "odd", "fine", F.posexplode(F.slice("head", 1, F.size("head") - 1)).alias("i", "w"))
    level = F.shiftrightunsigned("w", LOW).cast("int")
    part = F.when(level >= SPLIT, F.pmod(F.xxhash64("id"), F.call_function("shiftleft", F.lit(1).cast("long"), level - (SPLIT - 1)))).otherwise(0)
    group = Window.partitionBy("w", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = heads.withColumn("part", part).select("*", F.count(F.lit(1)).over(group).alias("near"), *[F.first(c).over(group).alias(f"p_{c}") for c in OWN])
    # A class that is alone in its part of a split word may have company in the others: join_keys looks for it.
    return found.withColumn("split", level >= SPLIT).where("near > 1 OR split").drop("part")


def join_keys(company: DataFrame, kinds: DataFrame) -> DataFrame:
    """w, id, n, i, odd, fine: what is left to join by words of three classes or more, hot words together with a second one."""
    left = company.where("split OR near > 2")
    if not left.where("split").isEmpty():
        shared = left.where("split").groupBy("w").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        left = left.where("NOT split").union(left.where("split").join(shared.select("w"), "w", "left_semi").select(*left.columns))
    hot = F.col("split") | (F.col("near") > HOT)
    if left.where(hot).isEmpty():
        return left.select("w", *OWN)
    pairs = left.where(hot).join(kinds.select("id", "head"), "id")
    second = pairs.select(*OWN, "w", F.explode(F.slice("head", F.col("i") + 2, F.size("head"))).alias("w2"))
    return left.where(~hot).select("w", *OWN).union(second.select(F.xxhash64("w", "w2").alias("w"), *OWN))


def full_sets(rows: DataFrame, kinds: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, words (hashes of all its words) of the wanted classes, from the texts of their first lines."""
    where = kinds.join(wanted, "id", "left_semi").select(F.col("first.rid").alias("rid"), F.struct(F.col("first.pos").alias("pos"), "id").alias("at"))
    by_text = where.groupBy("rid").agg(F.collect_list("at").alias("at"))
    lines = rows.select("rid", "text").join(by_text, "rid").select("at", once(F.split("text", "\n")).alias("lines")).select("lines", F.explode("at").alias("at"))
    words = F.array_distinct(F.array_remove(word_hashes(F.get("lines", F.col("at.pos"))), F.xxhash64(F.lit(""))))
    return lines.select("at.id", words.alias("words"))


def is_match(share: tuple[int, int]) -> Column:
    common = F.size(F.array_intersect("a_words", "b_words"))
    return common * (share[0] + share[1]) >= (F.size("a_words") + F.size("b_words")) * share[0]


def removed_lines(docs: DataFrame, share: tuple[int, int] = SHARE, least: int = LEAST) -> DataFrame:
    """rid, gone (places of the lines that an earlier line stands for) of the numbered texts that lose any."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), spaced(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    lines = scratch.keep(line_sets(rows, rarity(rows), least, share), "lines")
    kinds = scratch.keep(numbered_classes(lines), "kinds")
    copies = lines.join(kinds.where("copies > 1").select("d1", "d2", "first"), ["d1", "d2"]).where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos")))
    copies = scratch.keep(copies.select("rid", "pos"), "copies")
    scratch.drop(lines)
    company = scratch.keep(with_earliest(kinds, share), "company")
    # Pairs with the earliest class of a word.
    earliest = company.select("w", *[F.col(f"p_{c}").alias(f"a_{c}") for c in OWN], *[F.col(c).alias(f"b_{c}") for c in OWN])
    pairs = scratch.keep(earliest.where((F.col("a_id") < F.col("b_id")) & may_match(share)).select("a_id", "b_id").distinct(), "pivot-pairs")
    halves = lambda sets: [sets.select(F.col("id").alias(f"{s}_id"), F.col("words").alias(f"{s}_words")) for s in "ab"]
    sets = scratch.keep(full_sets(rows, kinds, pairs.select(F.col("a_id").alias("id")).union(pairs.select("b_id")).distinct()), "pair-sets")
    x, y = halves(sets)
    resolved = scratch.keep(pairs.join(x, "a_id").join(y, "b_id").where(is_match(share)).select(F.col("b_id").alias("id")).distinct(), "resolved")
    scratch.drop(pairs, sets)
    # Classes without a match so far that have another partner, and then these partners.
    keys = join_keys(company, kinds)
    a, b = (side(keys, s, *OWN) for s in "ab")
    partner = (F.col("a_id") < F.col("b_id")) & may_match(share)
    later = scratch.keep(b.join(a, (b["w"] == a["w"]) & partner, "left_semi"), "later-keys")
    open_ = scratch.keep(later.join(resolved, later["b_id"] == resolved["id"], "left_anti"), "open-keys")
    few = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
    earlier = scratch.keep(a.join(few, (a["w"] == few["w"]) & partner, "left_semi"), "earlier-keys")
    scratch.drop(company, later)
    sets = scratch.keep(full_sets(rows, kinds, open_.select(F.col("b_id").alias("id")).union(earlier.select("a_id")).distinct()), "line-sets")
    x, y = halves(sets)
    b, a = open_.join(y, "b_id").select("w", *[f"b_{c}" for c in OWN], "b_words"), earlier.join(x, "a_id").select("w", *[f"a_{c}" for c in OWN], "a_words")
    found = b.join(a, (b["w"] == a["w"]) & partner & is_match(share), "left_semi").select(F.col("b_id").alias("id"))
    gone = kinds.join(resolved.union(found).distinct(), "id", "left_semi").select("first.rid", "first.pos")
    out = scratch.keep(gone.union(copies).groupBy("rid").agg(F.collect_list("pos").alias("gone")), "gone")
    scratch.drop(copies, kinds, open_, earlier, sets, resolved)
    return out


def _cut(docs: DataFrame, columns: list[str], share: tuple[int, int], least: int) -> DataFrame:
    """The columns of docs with _tb_lines and _tb_gone, the places of the lines to remove (null for none)."""
    rows = numbered(docs, *columns, name="_tb_rid")
    gone = removed_lines(rows.select(F.col("_tb_rid").alias("rid"), "doc_id", "text"), share, least)
    marked = rows.join(gone.select(F.col("rid").alias("_tb_rid"), F.col("gone").alias("_tb_gone")), "_tb_rid", "left")
    return marked.withColumn("_tb_lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))


def kept_text() -> Column:
    gone = F.col("_tb_gone")
    left = F.array_join(F.filter("_tb_lines", lambda line, i: ~F.array_contains(gone, i)), "\n")
    return F.when(gone.isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(left)


def drop_repeated_lines(docs: DataFrame, share: tuple[int, int] = SHARE, least: int = LEAST) -> DataFrame:
    """docs with the remaining lines as text and, where there is a column n_chars, their code points in it."""
    out = _cut(docs, docs.columns, share, least).withColumn("_tb_text", kept_text())
    new = {"text": F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col("_tb_text")), "n_chars": F.when(F.col("_tb_gone").isNull(), F.col("n_chars") if "n_chars" in docs.columns else F.lit(0)).otherwise(F.length("_tb_text").cast("long"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def line_digest(docs: DataFrame, share: tuple[int, int] = SHARE, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining lines, joined) for every row."""
    out = _cut(docs, ["doc_id", "text"], share, least)
    n = F.when(F.col("_tb_gone").isNull(), F.lit(0)).otherwise(F.size("_tb_gone"))
    return out.select(F.col("doc_id").cast("long"), F.size("_tb_lines").cast("long").alias("n_lines"), n.cast("long").alias("n_removed"), F.sha2(kept_text(), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
words AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS ws FROM lines),
kinds AS (SELECT ws, min((doc_id, pos)) AS first, len(ws) AS n, row_number() OVER () AS k FROM words WHERE len(ws) >= 1 GROUP BY ws),
toks AS (SELECT k, n, unnest(ws) AS w FROM kinds),
freq AS (SELECT w, count(*) AS f FROM toks GROUP BY w),
heads AS (SELECT k, n, w FROM (SELECT k, n, w, row_number() OVER (PARTITION BY k ORDER BY f, w) AS i FROM toks JOIN freq USING (w)) WHERE i <= n - cast(ceil(n * {SHARE[0]} / {SHARE[1]}.0) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT a.k AS a, b.k AS b FROM heads a JOIN heads b ON a.w = b.w AND a.k < b.k AND least(a.n, b.n) * {SHARE[1]} >= greatest(a.n, b.n) * {SHARE[0]}),
later AS (
  SELECT DISTINCT greatest(x.first, y.first) AS first FROM pairs JOIN kinds x ON x.k = a JOIN kinds y ON y.k = b
  WHERE len(list_intersect(x.ws, y.ws)) * {SHARE[1]} >= (x.n + y.n - len(list_intersect(x.ws, y.ws))) * {SHARE[0]}),
judged AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(k.first <> (l.doc_id, l.pos) OR t.first IS NOT NULL, false) AS gone
  FROM lines l JOIN words w ON w.doc_id = l.doc_id AND w.pos = l.pos LEFT JOIN kinds k ON k.ws = w.ws LEFT JOIN later t ON t.first = (l.doc_id, l.pos))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
