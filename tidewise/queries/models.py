"""Queries of model calls, by a model that follows rules, with the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.operators import models
from tidewise.sources.shared import materialise, scratch

DEADLINE_S = 60.0


def _read_text(row: dict) -> dict:
    """Three rows for a text; some calls fail and some answers are prose."""
    n = int(row["url"])
    if n % 50 == 9:
        raise ConnectionError("busy")
    if n % 50 == 10:
        return {"answer": "There is no menu here."}
    items = [{"name": f"Text of {len(row['text'])}", "price": len(row["text"])}, {"name": "", "price": 1}, {"name": "Open", "price": "free"}]
    return {"answer": f"```json\n{json.dumps(items)}\n```"}


def _learn(row: dict) -> dict:
    n = len(row["html"])
    return {"answer": json.dumps({("menu_item" if n % 3 else "item"): f".of{n}", "item_name": "b"})}


def _see(row: dict) -> dict:
    """Prices on every second image only."""
    no = row["image_no"]
    return {"answer": json.dumps([{"name": f"{row['media_type']} {no} {k}", "price": None if no % 2 else no + k + len(row["data"])} for k in (1, 2, 3)])}


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return models.read_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("url"), "text"), _read_text, deadline_s=DEADLINE_S)


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the texts of all documents."""
    with scratch(spark) as keep:
        return keep(materialise(_texts(spark, sf_dir)[0].select("url", F.col("ord").cast("long").alias("ord"), "name", "price")))


def text_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed on the texts of all documents."""
    with scratch(spark) as keep:
        return keep(materialise(_texts(spark, sf_dir)[1]))


def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors learned from all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("url"), "html")
    with scratch(spark) as keep:
        found = models.learn_selectors(pages, _learn, deadline_s=DEADLINE_S)[0]
        return keep(materialise(found.select("url", F.element_at("selectors", "menu_item").alias("menu_item"), F.element_at("selectors", "item_name").alias("item_name"))))


def seen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on the first five page images of a document per page row, which has up to eight."""
    images = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null").select(F.col("page_id").cast("string").alias("url"), "page_id", F.explode(F.sequence(F.lit(1), (F.col("page_id") % 8 + 1).cast("int"))).alias("page_no"))
    kind = F.when(F.col("page_no") == 2, "image/png; x").when(F.col("page_id") % 2 == 0, "image/webp")
    images = models.first_pages(images).select(F.col("url").alias("site"), F.col("page_no").alias("image_no"), kind.alias("content_type"), F.repeat(F.lit("x"), F.col("page_no")).cast("binary").alias("data"))
    with scratch(spark) as keep:
        items = models.read_images(images, _see, deadline_s=DEADLINE_S)[0]
        return keep(materialise(items.select("site", F.col("image_no").cast("long").alias("image_no"), "name", "price")))


_ASKED = "(select doc_id, least(length(text), 15000) as n from documents where length(text) >= 200 and doc_id is not null)"
QUERIES = {
    "src13_text_items": (
        text_items,
        f"select doc_id::varchar as url, ord, case ord when 0 then 'Text of ' || n else 'Open' end as name, case ord when 0 then n::double end as price from {_ASKED}, (values (0::bigint), (2::bigint)) as r(ord) where doc_id % 50 not in (9, 10)",
    ),
    "sm08_model_failures": (
        text_failures,
        f"select doc_id::varchar as url, case doc_id % 50 when 9 then 'exception' else 'bad_answer' end as error_type, case doc_id % 50 when 9 then 'ConnectionError: busy' end as error_detail from {_ASKED} where doc_id % 50 in (9, 10)",
    ),
    "src14_selectors": (
        selectors,
        "select page_id::varchar as url, '.of' || least(length(html), 3000) as menu_item, 'b' as item_name from pages where least(length(html), 3000) % 3 <> 0",
    ),
    "src15_seen_items": (
        seen_items,
        """select page_id::varchar as site, no as image_no, case when no = 2 then 'image/png' when page_id % 2 = 0 then 'image/webp' else 'image/jpeg' end || ' ' || no || ' ' || k as name, (no + k + no)::double as price
from pages, (values (2::bigint), (4::bigint)) as i(no), (values (1), (2), (3)) as r(k) where no <= page_id % 8 + 1""",
    ),
}
