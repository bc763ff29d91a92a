import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewise.llm.quality_rules import LINES_SQL, ORACLE_SQL, quality_rules, remove_frequent_lines, repeated_window_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rnd = random.Random(5)
    out = [None, "", " \n ", "a", "a b", "a b c", "a a a a", "x y z x y z", "é# ü$\né# ü$\n\n", "a\x0bb c\x0ca b c", "a\x00b"]
    for _ in range(150):
        out.append("".join(rnd.choice("abc") + rnd.choice([" ", " ", "\n", "\t", "#"]) for _ in range(rnd.randrange(120))))
    return out


def test_base_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "s", True) for i, t in rows], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    for i, t in rows:
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


BLANKS = " \t\x0b\x0c\r"


def form(line):
    return re.sub("[0-9]+", "0", line.lower()).strip(BLANKS)


def brute_rest(rows, least=20, share=0.005, most=1000, depleted=0.5, enough=50):
    """(doc_id, text left or None where the document is depleted) of rows (doc_id, text, host)."""
    documents = {(i, h, t or "") for i, t, h in rows}
    of_host, count = {}, {}
    for _, h, t in documents:
        of_host[h] = of_host.get(h, 0) + 1
        for x in {form(x) for x in t.split("\n")} - {""}:
            count[h, x] = count.get((h, x), 0) + 1
    out = []
    for i, t, h in rows:
        limit = max(least, min(most, -int(-of_host[h] * share // 1)))
        lines = (t or "").split("\n")
        rest = [x for x in lines if not form(x) or count[h, form(x)] <= limit]
        before, after = len(WORD.findall(t or "")), len(WORD.findall("\n".join(rest)))
        gone = len(rest) < len(lines)
        out.append((i, t if not gone else "\n".join(rest) if before - after <= depleted * before and after >= enough else None, gone))
    return out


def planted():
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=7)) for _ in range(n))
    common = " ".join(f"c{chr(97 + i % 20)}{i}" for i in range(60))
    rows = [(i, f"\t{common} \n{prose(70 if i < 40 else 20)}", "h") for i in range(80)]
    rows += [(100 + i, f"{common}\n{prose(60)}", "other") for i in range(15)]  # too few in this host
    rows += [(200 + i, rows[0][1], None) for i in range(60)]  # copies of one text, each a document
    rows += [(300, prose(90) + "\n" + common, "rows")] * 60  # one document, repeated
    return rows


def test_frequent_lines_deplete(spark):
    rows = planted()
    got = {(r.doc_id): r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept and got[i].left_words == 70 for i in range(40))
    assert not any(got[i].kept or got[i].base_failed for i in [*range(40, 80), *range(200, 260)])
    assert all(got[i].kept for i in [*range(100, 115), 300])
    want = {i: rest is not None for i, rest, _ in brute_rest(rows)}
    assert all((r.base_failed or r.kept == want[i]) for i, r in got.items())


def test_frequent_lines_go(spark):
    """The texts against brute force, with odd spaces, numbers, empty lines, nulls, repeated rows and clashing names."""
    rnd = random.Random(7)
    shared = ["Share this page", "\tPage 12 of 300 ", "Ünïcode lïne"]
    own = lambda: "".join(rnd.choices("abcdefghij ", k=300))
    rows = [(i, "\n".join(rnd.choice([*shared, own(), own(), "", " \x0b"]) for _ in range(rnd.randrange(1, 9))), rnd.choice(["h", None])) for i in range(200)]
    rows += [(900, None, "h"), (901, "", None), rows[0], rows[0], *planted()]
    want = [(i, t, h) for (i, t, _), (_, _, h) in zip(brute_rest(rows), rows, strict=True) if t is not None or (i == 900)]
    names = ["_host", "_gone", "_lost", "host", "text_id", "gone_lines", "lost", "whole", "row", "new"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})
    got = remove_frequent_lines(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted(want, key=str) and 0 < len(want) < len(rows)
    assert all(tuple(r)[3:] == tuple(names) for r in got.collect())


@pytest.mark.parametrize("hosts", [None, 2])
def test_equals_sql(spark, hosts):
    """With few hosts some lines are above the limits."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    db = duckdb.connect()
    db.sql(f"create view documents as select doc_id, text, {'source' if hosts is None else f'(doc_id % {hosts})::varchar as source'} from read_parquet('{path}')")
    docs = docs if hosts is None else docs.withColumn("source", (F.col("doc_id") % hosts).cast("string"))
    got, want = sorted(map(tuple, quality_rules(docs).collect()), key=str), sorted(db.sql(ORACLE_SQL).fetchall(), key=str)
    assert got == want and any(r[-1] < r[1] for r in got) == (hosts is not None)
    rest = remove_frequent_lines(docs, least=5).select("doc_id", F.regexp_count("text", F.lit(WORD.pattern)), F.length("text"), F.sha2("text", 256))
    assert sorted(map(tuple, rest.collect()), key=str) == sorted(db.sql(LINES_SQL).fetchall(), key=str)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, None, None)], "doc_id long, text string, source string")
    assert quality_rules(df).count() == 3 and quality_rules(df.limit(0)).count() == 0


def test_windows_of_a_long_text(spark):
    df = spark.range(1).select(F.split(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: (x % 99_991).cast("string"))), " ").alias("w"))
    assert df.select(repeated_window_words(F.col("w"))).first()[0] == 200_000


@pytest.mark.parametrize("bits", [0, 2, 7, 63])
def test_windows_with_equal_hashes(spark, bits):
    """With few bits different windows stand between equal ones; the count stays exact."""
    rnd = random.Random(bits)
    rows = [(i, [rnd.choice("abcd") for _ in range(rnd.randrange(60))]) for i in range(60)] + [(60, "p a112805 b c q a3364984 b c r a112805 b c s a3364984 b c t".split())]
    df = spark.createDataFrame(rows, "i long, w array<string>")
    got = dict(df.select("i", repeated_window_words(F.col("w"), bits)).collect())
    assert got == {i: brute(" ".join(w))[4] for i, w in rows} and got[60] == 12


def test_runs_of_blanks_take_linear_time(spark):
    n = 1_000_000
    rows = [(1, "a" + " " * n + "b", "s"), (2, " " * n, "s"), (3, ("\t" * 50 + "x\n") * 20_000, "s")]
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_dup_lines) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: (2, 0), 2: (0, 0), 3: (20_000, 19_999)} and time.time() - began < 60
