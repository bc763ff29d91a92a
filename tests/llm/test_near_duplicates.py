import random

import numpy as np
from pyspark.sql import functions as F

from tidewise.llm.near_duplicates import _sets, components, drop_near_duplicates, near_duplicate_classes, prune_table
import pyarrow as pa


def shingle_set(text):
    """Brute force: sets of tuples of words."""
    import re

    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = [shingle_set(t) for t in texts]
    links = {t: 0 for t in texts}
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[a] += 1
                links[texts[j]] += 1
                root[top(a)] = top(texts[j])
    ids = {}
    for d, t in rows:
        ids.setdefault(top(t or ""), []).append(d)
    return sorted((d, min(x for x in ids[top(t or "")] if x is not None), links[t or ""]) for d, t in rows if d is not None)


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = rnd.choices(vocab, k=rnd.choice([1, 3, 5, 8, 60, 200]))
        for _ in range(rnd.choice([1, 1, 2, 6, 30])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " . "), (n + 3, rows[5][1]), rows[7], (n + 4, rows[9][1].upper())]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = sorted(map(tuple, near_duplicate_classes(df).select("doc_id", "class_id", "n_links").collect()))
    assert got == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("tidewise.llm.near_duplicates.BLOCK", 4)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicate_classes(df).select("doc_id", "class_id", "n_links").collect())) == brute(rows)
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == sorted({c for _, c, _ in brute(rows)})


def test_long_nodes_are_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr("tidewise.llm.near_duplicates.BLOCK_SHINGLES", 150)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicate_classes(df).select("doc_id", "class_id", "n_links").collect())) == brute(rows)
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == sorted({c for _, c, _ in brute(rows)})


def test_ids_of_text(spark):
    rows = corpus(8)
    df = spark.createDataFrame([(str(100000 + d), t) for d, t in rows], "doc_id string, text string")
    got = sorted((int(r.doc_id) - 100000, int(r.class_id) - 100000, r.n_links) for r in near_duplicate_classes(df).collect())
    assert got == brute(rows)


def test_kept_rows_have_a_total_order(spark):
    rows = [(1, "a b c d e f", "x", i) for i in range(6)] + [(2, "A, b c d e f", "y", 0), (3, "z", None, 1)]
    names = ["_node", "node", "row", "order", "n_same", "text_id"]
    read = lambda rows: sorted(map(tuple, drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, label string, n long").withColumns({c: F.lit(c) for c in names})).collect()))
    got = read(rows)
    assert got == read(rows[::-1]) and [r[0] for r in got] == [1, 3] and all(list(r[4:]) == names for r in got)


def test_empty_table_and_null_ids(spark):
    assert near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicate_classes(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.class_id is None, r.n_links) for r in got) == [(False, 0)] * 3 + [(True, 0)]


def test_posterior_rises(spark):
    t = prune_table(0.8, 1e-7)
    assert all(np.diff(t) > 0) and t[-1] < 0.8 * 128
    tight = prune_table(0.8, 1e-2)
    assert (tight >= t).all()


def test_components_of_a_chain(spark):
    n = 60
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "node long, root long")
    assert {r.label for r in components(df).collect()} == {0}


def test_sets_are_exact():
    texts = ["A b c d e f", "a B, c d e\nf", "x", ""]
    s = _sets(pa.array(texts))
    assert (s[0] == s[1]).all() and len(s[0]) == 2 and len(s[2]) == 1 and len(s[3]) == 0


def test_one_row_of_each_class_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1.5) for d, t in rows], "doc_id long, text string, class_id double")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c, _ in brute(rows)})
    nameless = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")
    assert drop_near_duplicates(nameless).count() == len({c for _, c, _ in brute(rows)})
