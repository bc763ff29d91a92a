import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewise.llm.mixing import ORACLE_SQL, apportion, mix_sources, sample_mix


def brute_targets(sizes):
    """{source: target} by sharing again until no target is above 3 times its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, list(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] >= 3 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def corpus(seed, n=400):
    rnd = random.Random(seed)
    names = ["b", "a", "é", "Z", None, "empty", "tiny"]
    rows = []
    for i in range(n):
        s = "a" if rnd.random() < 0.4 else rnd.choice(names[:5])
        rows.append((i, s, " \t".join(["w"] * rnd.choice([0, 1, 7, 30, 400]))))
    return rows + [(n, "empty", None), (n + 1, "tiny", "x y"), (None, "b", "q w\x0be"), rows[3], rows[3], (n + 2, "b", "")]


@pytest.mark.parametrize("kw", [{}, {"shard_words": 500}, {"blocks": 300, "shard_words": 900}])
def test_mix(spark, kw):
    rows = corpus(2)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, size string")
    got = mix_sources(df, **kw).collect()
    assert len(got) == len(rows)
    sizes, want = {}, {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        taken[r.source] += r.taken
    block = max(1, -(-sum(sizes.values()) // kw.get("blocks", 1_000_000)))
    for s in sizes:
        shards = -(-(sizes[s] + len(rows)) // kw.get("shard_words", 1 << 16))
        assert abs(taken[s] - targets[s]) <= block * (1 + shards), s
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df, **kw).collect()))


def test_equals_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = sorted(map(tuple, mix_sources(spark.read.parquet(f"{d}/documents.parquet")).collect()))
        db = duckdb.connect()
        db.sql(f"create view documents as select * from read_parquet('{d}/documents.parquet')")
        want = sorted(db.sql(ORACLE_SQL).fetchall())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 and g[4:] == w[4:], (g, w)


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r.taken, r.target, r.size) for r in mix_sources(df).collect()] == [(0, 0.0, 0)] * 2
    assert mix_sources(df.limit(0)).count() == 0


def test_apportionment_equals_listing_quotients(spark):
    rnd = random.Random(9)
    parties, want = [], {}
    for g in range(30):
        seats, votes = rnd.randrange(0, 60), [rnd.choice([0, 1, 1, 5, 17, 300, rnd.randrange(1, 10_000)]) for _ in range(rnd.randrange(1, 40))]
        keys = [g * 1000 + i for i in range(len(votes))]
        quotients = sorted(((-v / (2 * k + 1), key) for v, key in zip(votes, keys) if v for k in range(seats)))[:seats]
        for v, key in zip(votes, keys):
            parties.append((g, key, v, seats))
            want[key] = sum(q[1] == key for q in quotients)
    got = apportion(spark.createDataFrame(parties, "g long, key long, votes long, seats long"), ["g"], "key", "votes", "seats", "won")
    assert {r.key: r.won for r in got.collect()} == want


def test_sample_repeats_rows(spark):
    rows = [(i, s, t, "x") for i, s, t in corpus(2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    df = df.withColumns({c: F.lit(c) for c in ("row", "tie", "tie2", "n", "times", "time", "_high", "place")})
    want = sorted(str(r.doc_id) for r in mix_sources(df).collect() if r.size for _ in range(int(r.taken / r.size + 0.5)))
    got = sample_mix(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == want
    assert {tuple(r)[:4] for r in got.collect()} <= set(rows) and {tuple(r)[4:] for r in got.collect()} == {("row", "tie", "tie2", "n", "times", "time", "_high", "place")}


def test_a_row_that_fills_a_third_of_the_table(spark):
    """Equal rows are one entry, and come out as often as they are taken."""
    many = spark.range(150_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit("a b c").alias("text"))
    rest = spark.range(1000).select((F.col("id") + 100).alias("doc_id"), F.lit("cold").alias("source"), F.lit("x y").alias("text"))
    got = {r.source: (r.n, r.taken) for r in mix_sources(many.unionByName(rest)).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()}
    assert got["hot"] == (150_000, 446_000) and got["cold"] == (1000, 6000)
    out = {r.source: r["count"] for r in sample_mix(many.unionByName(rest)).groupBy("source").count().collect()}
    assert out["cold"] == 3000 and abs(out["hot"] * 3 - 446_000) <= 3 * 8
