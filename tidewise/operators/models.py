"""Items and selectors that a model reads in texts, pages and images. The model is a function that the caller passes; it is called in tasks, with a deadline each.

Each function writes the answers once, in the shared folder, so that neither a second reader nor a lost executor's neighbour asks for them again, and gives
the rows and the failures as two tables: `timeout` and `exception` as `providers.call_each` has them, `bad_answer` for an answer of another form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions import text as tx
from tidewise.operators import extract as ex
from tidewise.operators.providers import call_each
from tidewise.sources.shared import materialise

Model = Callable[[dict], dict]


def _asked(rows: DataFrame, call: Model, drop: tuple[str, ...], at_once: int, deadline_s: float) -> DataFrame:
    return materialise(call_each(rows, call, "answer string", at_once, deadline_s, drop).withColumn("answer", F.col("result.answer")).drop("result"))


def _failures(answers: DataFrame, keys: list[str], well_formed: Column) -> DataFrame:
    kind = F.coalesce("error_type", F.when(~F.coalesce(well_formed, F.lit(False)), "bad_answer"))
    return answers.select(*keys, kind.alias("error_type"), "error_detail").where("error_type is not null")


def _is_list(answer: Column) -> Column:
    return F.from_json(tx.without_fence(answer), "array<struct<name:string>>").isNotNull()


def read_texts(texts: DataFrame, call: Model, at_once: int = 5, deadline_s: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of cleaned texts (url, text).

    call gets {url, text} with the first 15,000 characters and gives {answer}: a JSON list of items, fenced or not. Texts below 200 characters and nulls are not asked
    about; rows without a name go, prices that are no numbers are null. A url that comes twice is asked about twice.
    """
    cut = texts.select("url", ex.model_text(F.col("text")).alias("text")).where("text is not null")
    answers = _asked(cut, call, ("text",), at_once, deadline_s)
    return ex.model_items(answers.where("error_type is null")), _failures(answers, ["url"], _is_list(F.col("answer")))


def learn_selectors(pages: DataFrame, call: Model, at_once: int = 5, deadline_s: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """(url and selectors, failures) of pages (url, html).

    call gets {url, html} with the first 3,000 characters and gives {answer}: a JSON object of selectors, which has to have `menu_item`. Null pages are not asked about.
    """
    cut = pages.select("url", ex.selector_html(F.col("html")).alias("html")).where("html is not null")
    answers = _asked(cut, call, ("html",), at_once, deadline_s)
    selectors = F.from_json(tx.without_fence(F.col("answer")), "map<string,string>")
    usable = F.length(F.element_at(selectors, "menu_item")) > 0
    found = answers.where("error_type is null").select("url", F.when(usable, selectors).alias("selectors")).where("selectors is not null")
    return found, _failures(answers, ["url"], usable)


def first_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` pages of each document (url, page_no, …), by number; of pages with one number all that come in time."""
    order = Window.partitionBy("url").orderBy("page_no")
    return pages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def read_images(images: DataFrame, call: Model, at_once: int = 5, deadline_s: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """(items, failures) of images (site, image_no, content_type, data).

    call gets these with `media_type` and gives {answer} as for texts. Items come from images with prices on 30 % or three of them, the first of a name, and from
    sites with three or more (`extract.image_items`). Images without data are not asked about.
    """
    known = images.where("data is not null").select("site", "image_no", F.coalesce(ex.media_type(F.col("content_type")), F.lit("image/jpeg")).alias("media_type"), "data")
    answers = _asked(known, call, ("data",), at_once, deadline_s)
    rows = ex.model_items(answers.where("error_type is null").select(F.struct("site", "image_no", "media_type").alias("url"), "answer"))
    items = ex.image_items(rows.select("url.*", F.col("ord").alias("pos"), "name", "description", "price", "category"))
    return items, _failures(answers, ["site", "image_no"], _is_list(F.col("answer")))
