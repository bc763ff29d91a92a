import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidewise.llm import multiset_hash as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vectors(spark, texts):
    rows = m.fingerprints(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    return [r.vector for r in rows]


def prose(seed, lines):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(12)) + "." for _ in range(lines))


def brute_next(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None}) + [None] * any(r[0] is None for r in rows)
    from hashlib import md5

    first = {i: min((r[1] or "" for r in rows if r[0] == i), key=lambda t: md5(t.encode()).hexdigest()) for i in ids}
    return {i: first[ids[(n + 1) % len(ids)]] for n, i in enumerate(ids)}


def test_paragraphs_are_the_text(spark):
    texts = ["", "a", "a.b!c?\n\n.", "x" * 1000, "é" * 121 + "\n", "🎈. " * 50, prose(1, 30)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(m.paragraphs(F.col("t")).alias("p")).collect()
    assert ["".join(r.p) for r in rows] == texts and all(len(p.rstrip("\n.!?")) <= 120 for r in rows for p in r.p)


def test_vector_against_brute_force(spark):
    """Sums of bits of the paragraphs' hashes, also beyond 2^16 paragraphs."""
    text = prose(2, 20) + "a\n" * 70_000 + "end"
    paras = re.findall(m.PARAGRAPH, text)
    known = {r.p: r.h for r in spark.createDataFrame([(p,) for p in set(paras)], "p string").select("p", F.array(*[F.xxhash64(F.lit(s), "p") for s in range(m.SEEDS)]).alias("h")).collect()}
    sums = [0] * (m.SEEDS * 64)
    for p in paras:
        for s, h in enumerate(known[p]):
            for bit in range(64):
                sums[64 * s + bit] += h >> bit & 1
    want = [sum((sums[64 * s + shift + 16 * k] & 0xFFFF) << 16 * k for k in range(4)) for s in range(m.SEEDS) for shift in (low + 4 * high for low in range(4) for high in range(4))]
    (got,) = vectors(spark, [text])
    assert [x & (1 << 64) - 1 for x in got[:-1]] == want and got[-1] & 0xFFFF == len(paras) & 0xFFFF


def test_order_insertion_deletion(spark):
    lines = [f"line {i} of the text.\n" for i in range(40)]
    other = lines[:]
    random.Random(3).shuffle(other)
    a, b, part, rest, more = vectors(spark, ["".join(lines), "".join(other), "".join(lines[:15]), "".join(lines[15:]), "".join(lines) + "one more.\n"])
    assert a == b != more
    calc = lambda f, x, y: spark.range(1).select(f(F.array(*map(F.lit, x)), F.array(*map(F.lit, y))).alias("v")).first().v
    assert calc(m.add, part, rest) == a and calc(m.subtract, a, rest) == part and calc(m.subtract, a, a) == [0] * (m.WIDTH + 1)
    assert calc(lambda x, y: m.fingerprint(m.add(x, y)), part, rest) == calc(lambda x, y: m.fingerprint(x), b, b)


def test_combined_groups(spark):
    texts = [f"line {i}.\nshared.\n" for i in range(30)]
    v = m.fingerprints(spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "g int, text string"))
    got = {r.g: r.vector for r in m.combined(v, ["g"]).collect()}
    want = vectors(spark, ["".join(texts[0::2]), "".join(texts[1::2])])
    assert [got[0], got[1]] == want


ROWS = [(10, prose(1, 20), "en", "s", 1), (11, prose(2, 30), "en", "s", 1), (11, prose(2, 30), "en", "s", 1), (11, "other text.", "en", "s", 1), (12, None, None, None, None), (13, "", "x", "s", 0), (14, "abc", "x", "s", 3), (15, prose(1, 20), "en", "s", 1), (None, "no id. " * 30, None, None, None), (16, "word " * 100_000, "x", "s", 0)]


def test_edits_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "next", "vector", "range", "kept", "paras", "head")})
    got = m.fingerprint_edits(docs).collect()
    after = brute_next(ROWS)
    edited = lambda i, t: t[: len(t) - len(t) // 4] + after[i][: len(t) // 4]
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(i), len(t or ""), sha256(edited(i, t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    # fingerprints of the edits, made by subtraction and addition, are those of the edited texts
    texts = [t or "" for _, t, *_ in ROWS] + [edited(i, t or "") for i, t, *_ in ROWS]
    from_text = {sha256(t.encode()).hexdigest(): f for t, f in zip(texts, [r.f for r in m.fingerprints(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").select(m.fingerprint(F.col("vector")).alias("f")).collect()], strict=True)}
    assert all(r.edited_fingerprint == from_text[r.edited_sha256] for r in got)
    own = sorted((str(r.doc_id), r.fingerprint) for r in got)
    assert own == sorted((str(i), from_text[sha256((t or "").encode()).hexdigest()]) for i, t, *_ in ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[12].near_edited == 1 and by_id[12].near_next == 1 and by_id[13].near_next == 0 and 0.5 < by_id[10].near_edited < 0.95 and by_id[10].near_next < 0.3


def test_one_document_and_none(spark):
    (r,) = m.fingerprint_edits(spark.createDataFrame([(1, "abcdefgh", "en", "s", 8)], SCHEMA)).collect()
    assert r.edited_sha256 == sha256(b"abcdefab").hexdigest() and r.near_next == 1
    assert m.fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_likeness_follows_shared_lines(spark):
    lines = [f"line {i} of a text about {i * 7919}.\n" for i in range(200)]
    changed = ["".join(lines[:keep] + [f"changed {keep} {i}.\n" for i in range(200 - keep)]) for keep in (200, 199, 150, 100, 0)]
    v = vectors(spark, changed)
    found = [spark.range(1).select(m.likeness(F.array(*map(F.lit, v[0])), F.array(*map(F.lit, x))).alias("s")).first().s for x in v]
    assert found[0] == 1 > found[1] and [abs(f - w) < 0.15 for f, w in zip(found, (1, 0.995, 0.75, 0.5, 0), strict=True)] == [True] * 5


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = m.fingerprint_edits(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    long_ = [r for r in rows if r.n_chars > 3000]
    assert sum(r.near_edited > r.near_next for r in long_) >= 0.97 * len(long_)
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len({f for s in by_text.values() for f in s}) == len(by_text)


@pytest.mark.parametrize("text", ["Thue.Morse.", "a.b.", "\n\n"])
def test_equal_texts_equal_fingerprints(spark, text):
    a, b = vectors(spark, [text, text])
    assert a == b
