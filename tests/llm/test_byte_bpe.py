import random
import struct

import public_tokenizers
import tiktoken

from tidewise.llm.byte_bpe import VOCABULARY, Encoder, RankQueue, decode_bpe, encode_bpe, encoder, round_trip_bpe


def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    out = ["", " ", "  a", "a  ", "\n\n x\t\ty", "aaaa" * 50, "!" * 999, "he's I'LL we've 12345 ½ ²", "<|endoftext|>", "日本語 тест 🙂🙂 é \x1c\x1d \x85 ​ x", "ab" * 3000]
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x2003, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x4E00, 0x0660]]
    return out + ["".join(rnd.choices(pool, k=rnd.randrange(80))) for _ in range(400)] + ["".join(rnd.choices("ab c", k=300)) for _ in range(50)]


def test_equals_library():
    ref, own = reference(), encoder()
    for t in texts():
        ids = list(struct.unpack(f"<{len(own.encode(t)) // 4}I", own.encode(t)))
        assert ids == ref.encode_ordinary(t), repr(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_long_pretoken_is_quick():
    own = encoder()
    t = "".join(random.Random(2).choices("abcdefgh", k=300_000))
    assert own.encode(t) == b"".join(struct.pack("<I", i) for i in reference().encode_ordinary(t))


def test_queue_orders_ranks():
    q, rnd = RankQueue(50_000), random.Random(3)
    pushed = [(rnd.randrange(50_000), i) for i in range(2000)]
    for r, i in pushed:
        q.push(r, i)
    got = []
    while (x := q.pop_rank())[0] >= 0:
        got += [(x[0], i) for i in sorted(x[1])]
    assert got == sorted(pushed)


def test_lower_rank_after_a_merge(tmp_path):
    """A vocabulary where a merge brings up a pair of lower rank."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cab", b"bc"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = Encoder(str(path), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for _ in range(300):
        t = "".join(random.choices("abc", k=random.randrange(1, 30)))
        assert own.merge(t.encode()) == ref.encode_ordinary(t), t
        assert own.encode(t) == b"".join(struct.pack("<I", i) for i in ref.encode_ordinary(t)), t


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr("tidewise.llm.byte_bpe.REMEMBERED", 5)
    own = Encoder(VOCABULARY, public_tokenizers.PATTERN)
    for t in texts()[:60]:
        assert own.decode(own.encode(t)) == t.encode()
    own.encode("a b")
    assert len(own.cache) + len(own.old) <= 5 + 2 + max(len(set(own.split(t))) for t in texts()[:60])


def test_long_pretokens_are_not_remembered(monkeypatch):
    monkeypatch.setattr("tidewise.llm.byte_bpe.TOGETHER", 4000)
    own, rnd = Encoder(VOCABULARY, public_tokenizers.PATTERN), random.Random(9)
    texts = ["".join(rnd.choices("abcdefgh", k=k)) + " end" for k in (32, 33, 500, 3000, 9000) for _ in range(4)]
    for ids, t in zip(own.encode_all(texts), texts, strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == reference().encode_ordinary(t)
    assert max(map(len, own.cache)) <= 32


def test_one_and_many_agree():
    own, ref = encoder(), reference()
    pieces = [t for x in texts() for t in own.split(x)]
    many = own.merge_many([t.encode() for t in pieces])
    for t, ids in zip(pieces, many):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == own.merge(t.encode()) == ref.encode_ordinary(t), t


def test_frame(spark):
    df = spark.createDataFrame([(1, "hi there", "old"), (2, None, "x"), (2, "", "x"), (None, "hi there", None)], "doc_id long, text string, ids string")
    got = decode_bpe(encode_bpe(df)).collect()
    assert [bytes(r.decoded) for r in got] == [b"hi there", b"", b"", b"hi there"] and len(got[0].ids) == 8 and got[0].ids == got[3].ids
    assert [(bytes(r.ids), bytes(r.decoded)) for r in round_trip_bpe(df).collect()] == [(bytes(r.ids), bytes(r.decoded)) for r in got]
    assert decode_bpe(encode_bpe(df.limit(0))).columns == ["doc_id", "text", "ids", "decoded"]
