"""Very long texts, columns of nulls, empty tables and clashing names, over all operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewise.llm.licence_scan import scan_licences
from tidewise.llm.mixing import mix_sources
from tidewise.llm.near_duplicates import drop_near_duplicates, near_duplicate_classes
from tidewise.llm.quality_classifier import score_quality, train
from tidewise.llm.quality_rules import quality_rules
from tidewise.llm.secret_scan import redact_secrets, scan_secrets
from tidewise.llm.telephony import read_media, store_media
from tidewise.llm.byte_bpe import round_trip_bpe
from tidewise.llm.training_order import read_slots, write_training_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} {i % 13}" for i in range(250_000))

OPERATORS = {
    "quality": lambda docs, d: score_quality(docs, train(docs, docs.select("doc_id", F.lit(1).alias("quality"))), keep=["doc_id"]),
    "licences": lambda docs, d: scan_licences(docs, ["doc_id"]),
    "telephony": lambda docs, d: read_media(store_media(docs, ["doc_id"]), ["doc_id"], pcm=False),
    "mixing": lambda docs, d: mix_sources(docs),
    "near_duplicates": lambda docs, d: near_duplicate_classes(docs),
    "order": lambda docs, d: write_training_order(docs, f"file://{d}/order").select("slot"),
    "bpe": lambda docs, d: round_trip_bpe(docs.select("doc_id", "text")),
    "rules": lambda docs, d: quality_rules(docs),
    "secrets": lambda docs, d: scan_secrets(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_texts_and_nulls(spark, tmp_path, name):
    rows = [(1, LONG, "en", "s", 1), (2, LONG + " end", None, None, None), (None, None, None, None, None), (3, "", "x", "s", 0), (3, "", "x", "s", 0)]
    got = OPERATORS[name](spark.createDataFrame(rows, SCHEMA), tmp_path).collect()
    if name == "order":
        assert len(got) == sum(1 for _ in read_slots(f"file://{tmp_path}/order"))
    else:
        assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None"]
    if name == "near_duplicates":
        assert {r.doc_id: r.class_id for r in got if r.doc_id in (1, 2)} == {1: 1, 2: 1}
    if name == "bpe":
        assert {bytes(r.decoded) for r in got} == {LONG.encode(), (LONG + " end").encode(), b""}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA), tmp_path).collect() == []


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2, [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_stages_of_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert (name == "tokens" or out.columns == docs.columns) and out.count() <= len(rows)


def test_clashing_names(spark):
    rows = [(1, "a b token = abcdefgh", "en", "s", 9), (2, None, None, None, None)]
    extra = {c: F.lit("x") for c in ("node", "size", "row", "tie", "text_hash", "start", "score", "ids", "shard", "found", "host", "label", "place")}
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(extra)
    for f in (scan_secrets, quality_rules, near_duplicate_classes, mix_sources):
        assert f(docs).count() == 2
    assert redact_secrets(docs).columns == drop_near_duplicates(docs).columns == docs.columns
    assert redact_secrets(docs).where("doc_id = 1").first().text == "a b [SECRET]"
