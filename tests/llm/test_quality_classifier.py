import math
import random

import numpy as np
import pyarrow as pa

from tidewise.llm import quality_classifier
from tidewise.llm.quality_classifier import DIMENSIONS, PASSAGE, fit, held_out, passages, score_quality, train
from tidewise.llm.words import chunks


def bags_of(texts):
    xs, bags = [], [0]
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        x, b = passages(data, offsets)
        xs.append(x)
        bags += [bags[-1] + n for n in b[1:]]
    return np.concatenate(xs), np.array(bags)


def test_passages_cover_whole_texts():
    texts = ["a " * 200, "", None, "### $$$", "é b"]
    x, bags = bags_of(texts)
    assert np.diff(bags).tolist() == [-(-200 // PASSAGE), 1, 1, 1, 1] and x.shape[1] == DIMENSIONS
    assert np.allclose(x[:, :13].sum(1), [1, 1, 1, 1, 0, 0, 1, 1])


def test_rows_do_not_touch_each_other():
    a, bags = bags_of(["ab cd ab", "ef", "x" * 50])
    for i, t in enumerate(["ab cd ab", "ef", "x" * 50]):
        assert np.array_equal(bags_of([t])[0], a[bags[i] : bags[i + 1]])


def slow_score(m, passages_of_bag):
    """One bag, one number at a time."""
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b, strict=True))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    hidden, weights = [], []
    for x in passages_of_bag:
        x = [(float(v) - float(mu)) * float(k) for v, mu, k in zip(x, m.mean, m.scale, strict=True)]
        h = [math.tanh(dot(x, m.W[:, j]) + float(m.b[j])) for j in range(m.W.shape[1])]
        gated = [math.tanh(dot(h, m.V[:, j])) * sigmoid(dot(h, m.U[:, j])) for j in range(m.V.shape[1])]
        hidden.append(h)
        weights.append(math.exp(dot(gated, m.w)))
    share = [w / sum(weights) for w in weights]
    pooled = [sum(a * h[j] for a, h in zip(share, hidden, strict=True)) for j in range(len(hidden[0]))]
    return sigmoid(dot(pooled, m.c) + float(m.d[0])), share


def test_scores_equal_brute_force():
    """Gated attention, pooling and score against loops; the attention of a bag sums up to one and differs between passages."""
    rnd = random.Random(3)
    texts = ["", "a b", *(" ".join(rnd.choices(["Word", "x1", "###", "one, two.", "é"], k=rnd.randrange(1, 400))) for _ in range(12))]
    x, bags = bags_of(texts)
    m = fit(x, bags, np.array([i % 2 for i in range(len(texts))], np.float32), epochs=4)
    got = m.score(x, bags)
    for i in range(len(texts)):
        want, share = slow_score(m, x[bags[i] : bags[i + 1]])
        assert abs(got[i] - want) < 1e-4 and abs(sum(share) - 1) < 1e-9
        assert len(share) == 1 or max(share) > min(share)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, bags, y = rng.standard_normal((9, DIMENSIONS)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    m = fit(x.astype(np.float32), bags, y.astype(np.float32), epochs=1)
    for k in ("W", "b", "V", "U", "w", "c", "d"):
        setattr(m, k, getattr(m, k).astype(np.float64))
    loss = lambda: -np.mean(y * np.log(m._forward(x, bags)[-1]) + (1 - y) * np.log(1 - m._forward(x, bags)[-1]))
    for k, grad in m.gradient(x, bags, y).items():
        value = getattr(m, k)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)]:
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6, (k, at)


def test_gradient():
    rng = np.random.default_rng(0)
    x, bags = rng.standard_normal((30, DIMENSIONS)).astype(np.float32), np.arange(0, 31, 3)
    y = (rng.random(10) > 0.5).astype(np.float32)
    m = fit(x, bags, y, epochs=60)
    assert (((m.score(x, bags)) > 0.5) == (y > 0.5)).all()
    assert np.array_equal(m.score(x, bags), fit(x, bags, y, epochs=60).score(x, bags))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = score_quality(docs, train(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id").where(held_out())
    rows = scored.select("predicted", "quality").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "some words", "x", 1.5), (None, None, "x", 1.5), (2, "", None, 0.0), (2, "", None, 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, train(docs, labels)).collect()
    assert [r.score for r in got] == [0.5] * 4 and score_quality(docs, train(docs, labels)).columns == ["doc_id", "text", "source", "score", "predicted"]
    one = labels.where("quality = 1").withColumn("doc_id", __import__("pyspark").sql.functions.lit(1).cast("long"))
    assert all(0 <= r.score <= 1 for r in score_quality(docs, train(docs, one)).collect())
    assert score_quality(docs.limit(0), train(docs, labels)).count() == 0


def learned(monkeypatch, docs, labels, **bounds):
    """(passages, label) of every document that fit() gets."""
    got = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, bags, y: got.extend(zip(np.diff(bags).tolist(), y.tolist(), strict=True)))
    train(docs, labels, **bounds)
    return got


def test_sample_is_bounded_before_it_is_collected(spark, monkeypatch):
    """A hot id counts once, and a long text with the first id or hash leaves room for the others."""
    ids = [i for i, keep in spark.range(1, 60).select("id", ~held_out("id")).collect() if keep]
    fit_mb = (1 << 20) // (4 * DIMENSIONS)
    long = " ".join(["Wörd_a1"] * (PASSAGE * fit_mb // 2 + PASSAGE))  # two words each: one passage too many
    for at in range(0, len(ids), 9):
        rows = [(d, long if i == at else f"w{d} " * (PASSAGE + 1)) for i, d in enumerate(ids)] + [(ids[1 if at == 0 else 0], None)] + [(ids[2 if at == 0 else 1], "x y")] * 300
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, quality int")
        got = learned(monkeypatch, docs.repartition(3), labels, passage_cap_mb=1)
        assert len(got) == len(ids) - 1 and all(n in (1, 2) for n, _ in got)
        assert [y for _, y in got] == [d % 2 for i, d in enumerate(ids) if i != at]
    assert max(n for n, _ in learned(monkeypatch, docs, labels)) > fit_mb and len(learned(monkeypatch, docs, labels, sample=7)) == 7


def test_sizes_are_those_of_the_features(spark):
    texts = ["", "a", "a_b c-d", "é🙂x" * 3 + " y" * 63, "[A]{Z}@`" * 40, "\x00w\x7fw" * 33, "9:9/9;" * 50]
    n = spark.createDataFrame([(t,) for t in texts], "text string").select(quality_classifier.F.regexp_count("text", quality_classifier.F.lit(quality_classifier.WORD))).collect()
    assert np.maximum(1, -(-np.array([r[0] for r in n]) // PASSAGE)).tolist() == np.diff(bags_of(texts)[1]).tolist()
