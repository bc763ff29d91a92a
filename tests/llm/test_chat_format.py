import duckdb

import random

import pytest

from tidewise.llm.chat_format import ORACLE_SQL, format_preferences
from tidewise.llm.queries import op2_preference_format


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def brute(c, r):
    p = 0
    while p < min(len(c), len(r)) and c[p] == r[p]:
        p += 1
    masks = []
    for x in (c, r):
        at, spans = 0, []
        for i in range(p, len(x)):
            end = at + len(render([x[i]]))
            if x[i][0] == "assistant":
                spans.append((end - 8 - len(x[i][1]), end))
            at = end
        masks.append(spans)
    return p, render(c[:p]), render(c[p:]), render(r[p:]), *masks


CASES = [
    ([("user", "hi"), ("assistant", "yo é🙂"), ("user", "a"), ("assistant", "b")], [("user", "hi"), ("assistant", "yo é🙂"), ("user", "a"), ("assistant", "c"), ("user", "d")]),
    ([("user", "hi")], [("user", "hi")]),
    ([("user", "hi")], []),
    ([("system", ""), ("assistant", "x")], [("user", ""), ("assistant", "x")]),
    ([("user", "hi"), ("assistant", "x")], [("user", "hi")]),
]


def joined(rows):
    """The pieces of each conversation put together."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.piece)):
        x = out.setdefault(r.conv_id, [r.n_prompt_turns, "", "", "", [], []])
        for k, c in enumerate(("prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"), 1):
            x[k] += r[c] if k < 4 else [tuple(m) for m in r[c]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("bucket, piece", [(4096, 1 << 20), (3, 50), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, bucket, piece):
    """Also where conversations are longer than a bucket and a piece."""
    monkeypatch.setattr("tidewise.llm.chat_format.BUCKET", bucket)
    monkeypatch.setattr("tidewise.llm.chat_format.PIECE", piece)
    rnd = random.Random(1)
    cases = list(CASES)
    for _ in range(40):
        c = [(rnd.choice(["user", "assistant"]), rnd.choice("abé") * rnd.randrange(20)) for _ in range(rnd.randrange(1, 15))]
        cases.append((c, c[: rnd.randrange(1, len(c) + 1)] + [(rnd.choice(["user", "assistant"]), "z") for _ in range(rnd.randrange(3))]))
    side = lambda k: spark.createDataFrame([(n, i, *t, "x") for n, pair in enumerate(cases) for i, t in reversed(list(enumerate(pair[k])))], "conv_id long, turn long, role string, text string, prompt string")
    got = joined(format_preferences(side(0), side(1)).collect())
    assert got == {n: brute(c, r) for n, (c, r) in enumerate(cases)}


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 0, "user", "x"), (2, 1, "assistant", None), (2, None, "user", "first")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = joined(format_preferences(c, c.where("conv_id = 1")).collect())
    assert got == {1: brute([(None, None)] * 2, [(None, None)] * 2), 2: brute([("user", "first"), ("assistant", "")], [])}
    assert format_preferences(c.limit(0), c.limit(0)).count() == 0


def test_a_conversation_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr("tidewise.llm.chat_format.PIECE", 5000)
    hot = [(7, i // 2, "assistant" if i % 2 else "user", f"turn {i // 6}") for i in range(30_000)]
    rows = hot + [(100 + i, 0, "user", "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    other = df.where("not (conv_id = 7 and turn >= 14000)")
    got = format_preferences(df, other).collect()
    assert max(len(r[c]) for r in got for c in ("prompt", "chosen", "rejected")) < 5050
    ordered = [t[2:] for t in sorted(hot, key=lambda t: t[1:])]
    assert joined(got)[7] == brute(ordered, ordered[:28_000])


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from read_parquet('{d}/conversations.parquet')")
    got = sorted(map(tuple, op2_preference_format(spark, d).collect()))
    assert got == sorted(db.sql(ORACLE_SQL).fetchall()) and any(r[2] for r in got) and any(r[6] for r in got)
