from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidewise.llm.filter_audit import ORDERS, audit_filters, counters, failures, own_failures, report

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
PROSE = " ".join(f"word{i}" for i in range(60))


def brute(rows, labels):
    """Rows of the report, filter by filter."""
    flags = {}
    for doc_id, quality, toxic in labels:
        old = flags.get(doc_id, (0, 0))
        flags[doc_id] = (max(old[0], int(quality == 1)), max(old[1], int(toxic == 1)))
    ids = {}
    for doc_id, text, _, _, _ in rows:
        if doc_id is not None:
            ids.setdefault(text or "", []).append(doc_id)
    docs = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        bad["E"] = doc_id is not None and any(other < doc_id for other in ids[text])
        docs.append((source or "", {c for c, is_bad in bad.items() if is_bad}, *(flags.get(doc_id, (0, 0)) if doc_id is not None else (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removals = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                removed = [d for d in left if c in d[1]]
                kept = [d for d in left if c not in d[1]]
                removals[c] += len(removed)
                failing = sum(c in d[1] for d in own)
                out[part, order, step] = [len(kept), len(removed), failing - len(removed), sum(d[1] == {c} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed)]
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removals[order[step - 1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


CASES = {
    "ties_and_nulls": [(1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, PROSE, "en", None, 1), (None, PROSE, "en", "a", 1), (3, None, None, "", None), (4, "", "x", "a", 0), (None, None, None, None, None), (5, PROSE + " #", "en", "a", 1), (6, PROSE.upper(), "en", "b", 1), (7, "w " * 80, "en", "b", 1)],
    "spaces": [(1, " ".join(["w"] * 60), "en", "s", 1), (2, "\x1c".join(f"w{i}" for i in range(60)), "en", "s", 1), (3, "\v".join(f"w{i}" for i in range(60)) + "É" * 100, "en", "s", 1)],
    "one_hot_text": [(i % 50, PROSE, "en", "s", 1) for i in range(300)] + [(1000 + i, f"{PROSE} {i}", "en", "s", 1) for i in range(40)],
    "very_long": [(1, "Lorem ipsum " * 200_000, "en", "s", 1), (2, "Lorem ipsum " * 200_000, "en", "s", 1), (3, "Lorem ipsum " * 200_000 + "x", "en", "s", 1)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    rows, labels = CASES[case], [(1, 1, 0), (1, 0, 1), (2, 1, None), (5, None, 1), (None, 1, 1), (7, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("part", "mask", "print", "row", "edge", "quality")})
    assert got(audit_filters(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_runs_over_many_ranges(spark):
    """One text in many ranges, fingerprints that begin and end in the middle of ranges."""
    rows = [(i, PROSE if i % 3 else f"{PROSE} {i % 7}", "en", f"s{i % 2}", 1) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        failed = failures(spark.createDataFrame(rows, SCHEMA)).where("mask >= 16").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert failed == 600 - len({r[1] for r in rows})


def test_counters_add_up(spark):
    rows = [(i, f"{PROSE} {i}" if i % 4 else f"few # {i}", "en", f"s{i % 3}", 1) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2, i % 5) for i in range(90)], LABELS)
    whole = got(audit_filters(spark.createDataFrame(rows, SCHEMA), labels))
    halves = [counters(failures(spark.createDataFrame(part, SCHEMA)), labels) for part in (rows[:40], rows[40:])]
    both = halves[0].unionByName(halves[1]).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    assert got(report(both)) == whole


def test_empty_and_other_ids(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit_filters(spark.createDataFrame([], SCHEMA), labels).collect() == []
    docs = spark.createDataFrame([("b", PROSE, "s"), ("a", PROSE, "s")], "doc_id string, text string, source string")
    assert sorted((r.doc_id, r["mask"]) for r in failures(docs).collect()) == [("a", 0), ("b", 16)]
    assert len(ORDERS) == 120 and own_failures(b"") == 1
