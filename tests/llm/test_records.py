"""Binary records: exact round trips, the index, and what is found broken."""

import random
import struct
import zlib

import numpy as np
import pytest

from tarnbeck.llm import records as R
from tarnbeck.llm.queries import QUERIES, tokenizer

ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "none"), (None, "none"), (-5, "Minus five."), (4, "twice"), (4, "twice"), (4, "thrice, other"), (2**62, "é ñ 字 \U0001f600 <|endoftext|>"), (7, "long words " * 40_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS rid", "1 AS shard", "2 AS start", "3 AS n_tokens")


def expected(rows):
    from tokenizers import Tokenizer

    tk, start, out = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # stable: rows of one doc_id as they come
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: r[1])


def test_digest_of_odd_rows(spark):
    assert ordered(R.record_digest(frame(spark, ODD).coalesce(1), tokenizer("word_bpe_49k.json")).collect()) == expected(ODD)


def test_digest_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert ordered(QUERIES["op13_binary_records"](spark, "/root/testdata/sf0.001").collect()) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert R.record_digest(frame(spark, []), tokenizer("word_bpe_49k.json")).collect() == []
    R.write_records(frame(spark, []), tokenizer("word_bpe_49k.json"), str(tmp_path / "r"))
    assert R.read_records(spark, str(tmp_path / "r")).collect() == [] and R.read_shuffled(spark, str(tmp_path / "r"), 1).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    rows = ODD + [(i, " ".join(rnd.choice(["one", "two", "three.", "Four,"]) for _ in range(rnd.randint(0, 300)))) for i in range(100, 400)]
    path = str(tmp_path_factory.mktemp("records") / "out")
    index = R.write_records(frame(spark, rows), tokenizer("word_bpe_49k.json"), path, shard_bytes=4000)
    return path, index, rows


def test_index_leads_to_every_record_in_any_order(spark, folder):
    path, index, rows = folder
    every = R.read_records(spark, path).collect()
    assert len(every) == len(rows) and len({r.shard for r in every}) > 20
    places = {(r.shard, r.offset): (r.doc_id, r.n_tokens) for r in index.collect()}
    assert places == {(r.shard, r.offset): (r.doc_id, r.n_tokens) for r in every}
    first, again, other = (R.read_shuffled(spark, path, seed).collect() for seed in (1, 1, 2))
    assert first == again != other and sorted(first, key=repr) == sorted(other, key=repr) == sorted(every, key=repr)
    some = index.where("doc_id % 7 = 0")
    got = R.read_at(spark, path, some).collect()
    assert sorted((r.shard, r.offset) for r in got) == sorted((r.shard, r.offset) for r in some.collect()) and all(r.doc_id % 7 == 0 for r in got)


def test_starts_are_running_sums_in_doc_id_order(spark, folder, monkeypatch):
    path, index, rows = folder
    assert [(r.start, r.n_tokens) for r in index.orderBy("start").collect()] == [e[1:3] for e in expected(rows)]
    monkeypatch.setattr(R, "GROUP", 3)
    sizes = index.groupBy("shard").agg({"n_tokens": "sum"}).toDF("shard", "n")
    total, bases = 0, {}
    for r in sorted(sizes.collect()):
        bases[r.shard], total = total, total + r.n
    assert {r.shard: r.base for r in R._starts(spark, sizes).collect()} == bases


def shard():
    docs = [(3, np.arange(5)), (None, np.arange(2))]
    return R.MAGIC + bytes([2]) + b"".join(R.frame(R.payload(i, ids, 2)) for i, ids in docs) + b"\n"


def test_one_shard_byte_by_byte():
    data = shard()
    own = R.Shard(data, "s")
    assert [(i, ids.tolist()) for i, ids in (own.record(p) for _, p in own.frames())] == [(3, [0, 1, 2, 3, 4]), (None, [0, 1])]
    (length,) = struct.unpack_from("<Q", data, 7)
    crc = zlib.crc32(data[7:15])
    assert length == 9 + 10 and struct.unpack_from("<I", data, 15)[0] == ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_any_changed_byte_is_found():
    data = shard()
    for i in range(len(data)):
        with pytest.raises(R.Broken):
            own = R.Shard(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :], "s")
            if own.width == 2:
                list(own.frames())
    for n in range(1, len(data)):
        with pytest.raises(R.Broken):
            list(R.Shard(data[:n], "s").frames())


def test_a_broken_shard_ends_the_job(spark, folder, tmp_path):
    import glob
    import os
    import shutil

    path, _, _ = folder
    copy = str(tmp_path / "copy")
    shutil.copytree(path, copy)
    name = sorted(glob.glob(f"{copy}/data/part-*"))[3]
    data = bytearray(open(name, "rb").read())
    data[40] ^= 4
    open(name, "wb").write(bytes(data))
    os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
    with pytest.raises(Exception, match="shard .*, offset"):
        R.read_records(spark, copy).collect()


def test_words_are_encoded_as_by_the_whole_tokenizer():
    """Also that the plain ones, words with punctuation and digits among them, don't go through it one by one."""
    from tokenizers import Tokenizer

    from tarnbeck.llm.word_ids import BlockTokens

    path = tokenizer("word_bpe_49k.json")
    rnd, tk, machine = random.Random(11), Tokenizer.from_file(path), BlockTokens(path)
    pools = ["abcdefgeeettth", "abc'stremlvd.,!&*\"<|>", "éèßöøÿñíã÷×ªµ'e", "0123456789-().", "ABCaé́İΣςﬁ北京½²٣", "a'l \n\t  .,"]
    texts = ["".join(rnd.choice(rnd.choice(pools) if rnd.random() < 0.05 else pool) for _ in range(rnd.randint(0, 30))) for pool in pools for _ in range(1500)]
    texts += [" ".join(rnd.sample(texts, 20)) for _ in range(50)] + ["<|endoftext|>", "x<|startoftext|>y", "'s 't're can't we'll !!'s", "", " "]
    ids, counts = machine.block(texts)
    ends = counts.cumsum()
    for text, n, end in zip(texts, counts.tolist(), ends.tolist()):
        assert ids[end - n : end].tolist() == tk.encode(text, add_special_tokens=False).ids, repr(text)
    slow, machine._learn_parts = [], lambda parts: slow.extend(parts)
    machine.block(["den555-7240 enelleeux*** (262) thshble!! añoñasí'll password=b13d"])
    assert slow == []


def test_a_worker_remembers_a_bounded_number_of_parts(monkeypatch):
    from tokenizers import Tokenizer

    from tarnbeck.llm import word_ids

    monkeypatch.setattr(word_ids, "MEMO_PARTS", 300)
    monkeypatch.setattr(word_ids, "KEPT_PARTS", 100, raising=False)
    path, rnd = tokenizer("word_bpe_49k.json"), random.Random(5)
    machine, whole, most = word_ids.BlockTokens(path), Tokenizer.from_file(path), 0
    for k in range(30):
        texts = ["The first words come again. " + " ".join(f"Part{rnd.randint(0, 4000)}\u00e9 {rnd.choice(['x', '字', '<|a'])}{k}" for _ in range(20)) for _ in range(3)]
        ids, counts = machine.block(texts)
        assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]
        assert counts.tolist() == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
        most = max(most, len(machine.place))
        assert "first" in machine.place
    assert most <= 300 and machine.used <= len(machine.flat) < 1 << 20


def test_a_batch_is_cut_without_a_copy_of_its_texts():
    """An encoding worker holds the batch that Spark sent and one block; nulls, empty and longer texts keep their places."""
    import pyarrow as pa

    from tarnbeck.llm.common import slices

    texts = [None, "", "x" * 70_000, "é" * 40_000, "y" * 900_000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    before, rows, most = pa.total_allocated_bytes(), [], 0
    for part in slices([batch.slice(0, 0), batch.slice(1), batch.slice(0, 1)], 200_000):
        rows += part.column("text").to_pylist()
        assert part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column("text").to_pylist()) <= 200_000
        most = max(most, pa.total_allocated_bytes() - before)
    assert rows == texts[1:] + texts[:1] and most < 100_000 < batch.nbytes


def test_writing_hands_over_small_batches_and_leaves_the_setting(spark, tmp_path, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(R, "BATCH_ROWS", 1)
    R.write_records(frame(spark, ODD).coalesce(1), tokenizer("word_bpe_49k.json"), str(tmp_path / "one"))
    assert spark.conf.get(key) == before
    got = R.read_records(spark, str(tmp_path / "one")).orderBy("shard", "offset").collect()
    assert [(r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got] == [(i, n, crc) for i, _, n, crc in expected(ODD)]


def test_the_tasks_of_a_worker_share_one_tokenizer(monkeypatch):
    """A task's function is unpickled anew for each task, and so is what it doesn't name by its module."""
    import pickle

    import pyarrow as pa
    from pyspark import cloudpickle

    from tarnbeck.llm.word_ids import BlockTokens

    class Stop(Exception):
        pass

    class Frame:
        def __getattr__(self, name):
            return self

        def __call__(self, *a):
            if a and not isinstance(a[0], Frame) and callable(a[0]):
                raise Stop(a[0])
            return self

    loads, init, path = [], BlockTokens.__init__, tokenizer("word_bpe_49k.json")
    monkeypatch.setattr(BlockTokens, "__init__", lambda self, p: loads.append(p) or init(self, p))
    monkeypatch.setattr(R, "numbered", lambda *a: Frame())
    monkeypatch.setattr(R.F, "col", lambda name: Frame())
    with pytest.raises(Stop) as sent:
        R.write_shards(Frame(), path, "nowhere")
    raw = cloudpickle.dumps(sent.value.args[0])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])
    first, second = ([b.column("shard").to_pylist() for b in pickle.loads(raw)([batch])] for _ in range(2))
    assert first == second and len(loads) <= 1
