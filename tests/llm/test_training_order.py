import zlib

import numpy as np
import pytest

from tidewise.llm.training_order import _encoding, VOCABULARY, permute, read_slots, write_training_order
import public_tokenizers


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    slots = permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 64 or (permute(np.arange(n), n, 8) != slots).any() and (np.sort(slots[: n // 2]) != np.arange(n // 2)).any()


def texts():
    return [(1, "hello world " * 70), (2, ""), (None, None), (3, "a"), (3, "a"), (4, "é" * 333), *((10 + i, f"text {i} " * i) for i in range(60))]


@pytest.mark.parametrize("block, kind, parts", [(8192, "<u2", 4096), (3, "<u4", 2)])
def test_shards_hold_every_text_once(spark, tmp_path, monkeypatch, block, kind, parts):
    """Also with wide ids, small blocks and fewer range partitions than shards."""
    monkeypatch.setattr("tidewise.llm.training_order.BLOCK", block)
    monkeypatch.setattr("tidewise.llm.training_order.id_type", lambda end: kind)
    rows, length = texts(), 16
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, slot string").repartition(5)
    folder = f"file://{tmp_path}/order"
    index = write_training_order(df, folder, length=length, per_shard=32, most_parts=parts).collect()
    got = [s.tolist() for s in read_slots(folder)]
    assert len(got) == len(index) and sorted(r.slot for r in index) == list(range(len(got)))
    encode, pieces = _encoding(VOCABULARY, public_tokenizers.PATTERN).encode_ordinary, {}
    for r in index:
        assert r.shard == r.slot // 32 and r.offset == r.slot % 32 * np.dtype(kind).itemsize * length
        begin = 0
        for t in r.texts:
            pieces.setdefault(t.doc_id, []).append((t.at, tuple(got[r.slot][begin : begin + t.n])))
            begin += t.n
        assert set(got[r.slot][begin:]) <= {50256}
    for d in {d for d, _ in rows}:
        whole = [(*encode(t or ""), 50256) for x, t in rows if x == d]
        if len(whole) == 1:
            assert sum((p for _, p in sorted(pieces[d])), ()) == whole[0]
        else:
            assert sorted(sum((p for _, p in pieces[d]), ())) == sorted(sum(whole, ()))
    for r in index:
        assert zlib.crc32((tmp_path / "order" / f"shard-{r.shard:08d}.bin").read_bytes()) == r.shard_crc32
    for start in (0, 31, 32, 33, len(got) - 1):
        assert [s.tolist() for s in read_slots(folder, start, start + 40)] == got[start : start + 40]


def test_same_input_same_bytes(spark, tmp_path):
    df = spark.createDataFrame(texts(), "doc_id long, text string").coalesce(1)
    for name in "ab":
        write_training_order(df, f"file://{tmp_path}/{name}", length=8, per_shard=64)
    assert [(p.name, p.read_bytes()) for p in sorted((tmp_path / "a").iterdir())] == [(p.name, p.read_bytes()) for p in sorted((tmp_path / "b").iterdir())]


def test_split_sizes_make_the_order(spark, tmp_path):
    """The same splits give the same bytes; other splits give other sequences of the same texts."""
    df = spark.createDataFrame(texts(), "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/docs")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    bag = lambda name: sorted(i for x in read_slots(f"file://{tmp_path}/{name}") for i in x.tolist() if i != 50256)
    try:
        for name, size in (("a", old), ("b", old), ("c", "256")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            write_training_order(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/{name}", length=8, per_shard=64)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    files = lambda name: [(p.name, p.read_bytes()) for p in sorted((tmp_path / name).glob("shard*"))]
    assert files("a") == files("b") and bag("a") == bag("c")


def test_ids_of_text(spark, tmp_path):
    df = spark.createDataFrame([("x", "a b"), (None, "c")], "doc_id string, text string")
    got = write_training_order(df, f"file://{tmp_path}/t", length=4).collect()
    assert {t.doc_id for r in got for t in r.texts} == {"x", None}


def test_empty(spark, tmp_path):
    assert write_training_order(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e").count() == 0
    assert list(read_slots(f"file://{tmp_path}/e")) == []
