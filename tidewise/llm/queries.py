"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.llm import chat_format, filter_audit, licence_scan, merkle, mixing, multiset_hash, near_duplicates, quality_rules, secret_scan, telephony
from tidewise.llm.byte_bpe import round_trip_bpe
from tidewise.llm.licence_scan import scan_licences
from tidewise.llm.near_duplicates import near_duplicate_classes
from tidewise.llm.quality_classifier import held_out, score_quality, train
from tidewise.llm.secret_scan import scan_secrets
from tidewise.llm.shared import materialise, scratch, shared_dir
from tidewise.llm.training_order import write_training_order

def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels of those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, threshold=0.3, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen, the same with a weaker last reply as rejected."""
    with scratch(spark) as keep:
        chosen = keep(materialise(chat_format.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    pairs = chat_format.format_aligned(chat_format.weaker_replies(chosen)).withColumnRenamed("key", "conv_id")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return pairs.withColumns({c: text(c) for c in ("chosen_mask", "rejected_mask")})


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered template spans of every document."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a telephony file, read back, decoded and stored as PCM of 4 kHz; length and digest of the PCM as stored."""
    return _sounds(spark, sf_dir, telephony.TARGET)


def telephony_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with PCM of 16 kHz, which is four to eight times the text."""
    return _sounds(spark, sf_dir, 16_000)


def _sounds(spark: SparkSession, sf_dir: str, target: int) -> DataFrame:
    stored = telephony.store_pcm(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], target=target)
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec"]
    return stored.select(*columns, F.length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with weights 1, 2, 3 by source takes of every document."""
    return mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity of 0.8 or more."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents' sequences in training order, written in the shared folder; the index of every sequence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_training_order(docs, f"{shared_dir(spark)}/tidewise/order-{uuid.uuid4().hex}")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = round_trip_bpe(docs)
    return coded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the frequency of lines across the documents of a source, for every document."""
    return quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that more than five documents of its source share, as digests."""
    rest = quality_rules.remove_frequent_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=5)
    text = F.coalesce("text", F.lit(""))
    return rest.select("doc_id", F.regexp_count(text, F.lit(quality_rules.WORD)).cast("long").alias("n_words"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by patterns and by tests of randomness."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by source."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return filter_audit.audit_filters(read("documents"), read("labels"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike it is to that and to the next document."""
    return multiset_hash.fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def edited_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op12 that SQL can express."""
    return op12_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def template_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of whole texts of a table, those of benchmark, in every document: the same automaton over templates that a user brings."""
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("label"), "text", F.lit(None).cast("array<string>").alias("deciding"))
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], phrases={}, templates=licence_scan.templates_of(table))
    return found.where("labels <> ''").select("doc_id", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_licence_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def telephony_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return op4_telephony_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_quality_classifier,
        op2_preference_format,
        op3_licence_scan,
        op4_telephony_audio,
        telephony_pcm,
        op5_mixing_sources,
        op6_ngram_jaccard_join,
        op7_training_order,
        op8_byte_bpe,
        op9_quality_rules,
        op9_document_lines,
        op10_secret_scan,
        op11_filter_audit,
        op12_document_fingerprints,
        op13_merkle_manifest,
        edited_base,
        template_scan,
        licence_base,
        telephony_payload,
        secret_base,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_preference_format": chat_format.ORACLE_SQL,
    "op5_mixing_sources": mixing.ORACLE_SQL,
    "op6_ngram_jaccard_join": near_duplicates.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op9_document_lines": quality_rules.LINES_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
    "edited_base": multiset_hash.BASE_SQL,
    "licence_base": licence_scan.BASE_SQL,
    "telephony_payload": telephony.PAYLOAD_SQL,
    "secret_base": secret_scan.BASE_SQL,
}
