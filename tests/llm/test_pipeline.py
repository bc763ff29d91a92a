"""Each stage of the pipeline against brute force on its own input, and run() against the stages."""

import hashlib
import struct

from pyspark.sql import Row

import corpus_pipeline
from tests.llm.test_byte_bpe import reference
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_duplicates import shingle_set
from tests.llm.test_secret_scan import brute as brute_secrets

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    everything = docs.collect()

    good = stages["quality"](spark, docs, DIR)
    assert good.columns == COLUMNS
    kept = good.collect()
    assert set(kept) <= set(everything)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    known = [r for r in everything if r.doc_id in labels]
    right = sum((r in set(kept)) == bool(labels[r.doc_id]) for r in known)
    assert right / len(known) > 0.9

    good = spark.createDataFrame(kept, docs.schema)
    single = stages["near_duplicates"](spark, good, DIR)
    sets, groups = [shingle_set(r.text) for r in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if kept[i].text == kept[j].text or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = groups[i], groups[j]
                groups = [min(a, b) if g in (a, b) else g for g in groups]
    want = {min(r.doc_id for r, g in zip(kept, groups) if g == x) for x in set(groups)}
    singles = single.collect()
    assert single.columns == COLUMNS and {r.doc_id for r in singles} == want and len(singles) == len(want) < len(kept)

    leak = singles[0].text + ' token = "11acdfb36bb72224148e6160f674b4be45601bff" é'
    singles[0] = Row(**singles[0].asDict() | {"text": leak, "n_chars": len(leak)})
    single = spark.createDataFrame(singles, docs.schema)
    clean = stages["secrets"](spark, single, DIR)
    cleaned = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == COLUMNS and set(cleaned) == want
    changed = 0
    for r in singles:
        if brute_secrets(r.text):
            assert cleaned[r.doc_id].text != r.text and not brute_secrets(cleaned[r.doc_id].text) and cleaned[r.doc_id].n_chars == len(cleaned[r.doc_id].text)
            changed += 1
        else:
            assert cleaned[r.doc_id] == r or "[SECRET]" in cleaned[r.doc_id].text
    assert changed

    clean = spark.createDataFrame(list(cleaned.values()), docs.schema)
    mixed = stages["mix"](spark, clean, DIR)
    rows = mixed.collect()
    assert mixed.columns == COLUMNS and set(rows) <= set(cleaned.values())
    sizes, taken = {}, {}
    for r in cleaned.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        assert rows.count(r) <= 3
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, target in brute_targets(sizes).items():
        largest = max(len(r.text.split()) for r in cleaned.values() if r.source == source)
        assert abs(taken.get(source, 0) - target) <= largest + 20

    last = stages["tokens"](spark, spark.createDataFrame(rows, docs.schema), DIR)
    ref, got = reference(), sorted(map(tuple, last.collect()))
    want = []
    for r in rows:
        ids = ref.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert got == sorted(want)


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    seen = []

    def stage(name):
        def f(spark, docs, sf_dir):
            seen.append((name, docs.count()))
            return docs.where(f"doc_id % {len(seen) + 1} <> 0")

        return name, f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in "abc"])
    ids = [r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = [r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()]
    assert sorted(got) == sorted(i for i in ids if i % 2 and i % 3 and i % 4)
    assert seen == [("a", len(ids)), ("b", sum(i % 2 > 0 for i in ids)), ("c", sum(i % 2 > 0 and i % 3 > 0 for i in ids))]
