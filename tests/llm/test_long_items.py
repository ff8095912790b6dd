"""Decontamination of very long items and documents, its recall near the bound, and weighted similarity."""

import random
from collections import Counter

from tarnbeck.llm import decontam


def brute(docs, items, k=5):
    def shingles(text):
        w = (text or "").lower().split()
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []

    out = set()
    for d, text in docs:
        s = shingles(text)
        for i, item in items:
            t = shingles(item)
            if not s or not t:
                continue
            want, best = Counter(t), None
            for start in range(max(len(s) - len(t), 0) + 1):
                own = Counter(s[start : start + len(t)])
                common = sum(min(n, want[x]) for x, n in own.items())
                total = sum(own.values()) + len(t) - common
                if 100 * common >= 75 * total and (best is None or common > best[1]):
                    best = (start, common, total)
            if best:
                out.add((d, i, *best))
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("aa bb cc dd ee ff gg hh".split()) if rnd.random() < 0.4 else f"w{rnd.randint(0, 500)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 6, 12, 40])))) for i in range(12)] + [(20, "ab ab ab ab ab ab ab ab ab ab"), (20, "ab ab ab ab ab ab ab ab ab ab")]
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 2)):
            w = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = "changed"
            parts += [" ".join(w), " ".join(word() for _ in range(rnd.randint(0, 10)))]
        docs.append((d, " ".join(parts)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.leaked_items(df, bench, radius=32).collect()]
    assert set(got) == brute(docs, items) and len(got) == len(brute(docs, items)) + sum(1 for x in set(got) if x[1] == 20)


def test_items_and_documents_of_100000_words(spark):
    words = [f"w{k % 9973}x{k % 7}" for k in range(100_000)]
    docs = [(1, " ".join(words)), (2, "a b c d e f"), (3, "same " * 100_000), (4, "before " * 50 + " ".join(words[:1000]) + " after" * 50)]
    items = [(1, " ".join(words)), (2, "same " * 80_000), (3, " ".join(words[10:990]))]
    got = decontam.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (1, 3), (4, 3)}


def test_recall_between_the_bound_and_085(spark):
    rnd = random.Random(9)
    items, docs = [], []
    for i in range(300):
        w = [f"i{i}w{k}" for k in range(120)]
        items.append((i, " ".join(w)))
        for _ in range(3):
            w[rnd.randrange(120)] = "changed"
        docs.append((i, " ".join(w)))
    got = {(r.doc_id, r.item_id) for r in decontam.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    true = {x[:2] for d in range(300) for x in brute([docs[d]], [items[d]])}
    assert len(true) > 200 and len(got & true) >= 0.97 * len(true) and not got - true


def test_words_are_hashed_by_pieces(monkeypatch):
    import tracemalloc

    import numpy as np

    from tarnbeck.llm import grams

    def hashes(texts):
        raw = [t.encode() for t in texts]
        return grams.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))]).astype(np.int64)).hashes()

    texts = ["", " a bb a", "ab" * 40, "a\tBB " * 30, "字 é " * 20]
    whole = hashes(texts)
    monkeypatch.setattr(grams, "PIECE_BYTES", 7, raising=False)
    assert (hashes(texts) == whole).all() and len(set(whole.tolist())) == 5
    monkeypatch.undo()
    text = "some words " * 400_000
    tracemalloc.start()
    hashes([text])
    assert tracemalloc.get_traced_memory()[1] < 12 * len(text)  # the bytes, flags and places of words among it
    tracemalloc.stop()
