import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidewise.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes, at):
    """(root, siblings of nodes[at] level by level, how its root follows from another digest)."""
    steps, siblings = [], []
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        run, slot = runs[at // 8], at % 8
        siblings += run[:slot] + run[slot + 1 :]
        steps.append((run, slot))
        nodes, at = [H(*r) for r in runs], at // 8
    return nodes[0], siblings, steps


def brute(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    subroots = [climb([leaf(*r) for r in by_lang[lang]], 0)[0] for lang in langs]
    out = []
    for no, lang in enumerate(langs):
        leaves = [leaf(*r) for r in by_lang[lang]]
        root, above, high = climb(subroots, no)
        for i, r in enumerate(by_lang[lang]):
            _, siblings, steps = climb(leaves, i)
            now = leaves[i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for run, slot in steps + high:
                now = H(*run[:slot], now, *run[slot + 1 :])
            out.append((r[0], leaves[i], subroots[no], root, H(*siblings, *above), now, now == root))
    return out


def many(n, langs):
    return [(i * 3 % 1009, f"Text {i} É" if i % 4 else None, langs[i % len(langs)], f"s{i % 3}" if i % 5 else None, i if i % 7 else None) for i in range(n)]


CASES = {
    "one": [(5, "A text", "en", "s", 6)],
    "a_lone_leaf_a_language": [(1, "Ab", "en", "s", 2), (2, "Cd", None, "s", 2), (3, "", "", None, 0)],
    "eight_and_nine": [(i, f"T{i}", "en", "s", i) for i in range(8)] + [(i, f"T{i}", "de", "s", i) for i in range(9)],
    "levels": many(700, ["en", "en", "en", "de", None]),
    "many_languages": many(200, [f"l{i}" for i in range(70)]),
    "ties_and_nulls": [(1, "Same", "en", "s", 4)] * 20 + [(None, None, None, None, None)] * 3 + [(None, "X", "en", None, None), (1, "Other", "en", "s", 5)],
    "very_long": [(3, "Ab " * 1_000_000, "en", "s", 1), (6, "É" * 1_000_000, "en", "s", 1)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    docs = spark.createDataFrame(CASES[case], SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("tree", "digest", "idx", "n", "changed", "range", "no", "tie", "level")})
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=key) == sorted(brute(CASES[case]), key=key)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_path_proves_one_leaf_only():
    run = b"".join(bytes([i]) * 32 for i in range(5))
    path = merkle.entry(2, run) + merkle.entry(0, bytes(32))
    root = merkle.parent(merkle.parent(run))
    assert merkle.fold(bytes([2]) * 32, path) == root and merkle.fold(bytes([3]) * 32, path) != root
    assert [(s, len(x)) for s, x in merkle.entries(path)] == [(2, 128), (0, 0)] and merkle.siblings(path) == run[:64] + run[96:]


def test_ranges_number_leaves(spark):
    rows = [(i % 50, "en" if i % 3 else None, f"{i:064x}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, tree string, digest string")
    got = merkle.placed(df, [F.col("doc_id"), F.col("digest")]).collect()
    for tree in ("en", None):
        own = sorted((r for r in got if r.tree == tree), key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [(r.doc_id, r.digest) for r in own] == sorted((r.doc_id, r.digest) for r in own)
