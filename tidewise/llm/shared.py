"""Tables in the shared folder, and Arrow batches for rows that hold whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.sources.shared import materialise, scratch, shared_dir

__all__ = ["map_texts", "materialise", "scratch", "shared_dir", "text_id"]

#: Rows of an Arrow batch where rows hold whole texts: memory of a task is a few times one batch.
TEXT_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_texts(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with batches of at most TEXT_ROWS rows. The session keeps that setting, where its own is larger."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_ROWS)) <= TEXT_ROWS:
        spark.conf.set(_ROWS, str(TEXT_ROWS))
    return df.mapInArrow(run, schema)


def text_id(text: Column | str) -> Column:
    """128 bits (md5) that stand for a text; null for null."""
    return F.unhex(F.md5(text))
