"""Structured Streaming forms of ingestion, of tables that batches are merged into, and of type-ahead queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, pause: str = "300 milliseconds", late: str = "10 seconds", least: int = 2) -> DataFrame:
    """The last text of each burst of typing (user_id, ts, text): bursts end with a pause; short texts are none.

    The same for a table and for a stream, where a burst comes out once the watermark has passed it.
    """
    timed = events.where(F.length("text") >= least)
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    bursts = timed.groupBy("user_id", F.session_window("ts", pause)).agg(F.max_by("text", "ts").alias("text"), F.count("*").alias("n_keys"))
    return bursts.select("user_id", F.col("session_window.start").alias("started_at"), "text", "n_keys")


def ingest_stream(searches: DataFrame, look_up: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work through a stream of searches once: each batch is looked up, deduplicated by place_id and merged.

    The checkpoint folder holds where a run stopped, so the next one resumes there; a batch that failed comes again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        merge(look_up(rows).dropDuplicates(["place_id"]), number)

    return searches.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_merge(spark: SparkSession, table: str, key: str, upsert: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A merge of batches into a Parquet table that is dealt to `buckets` by a hash of its key.

    Batch n rewrites the buckets that it touches, as version n + 1, and leaves the others; a small table of versions says which files hold which bucket. No
    path is read and overwritten at once, and a batch that comes again writes the same version again.
    """

    def merge(rows: DataFrame, number: int) -> None:
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]  # at most `buckets`
        versions = _versions(spark, table, number)
        old = _buckets(spark, table, {b: v for b, v in versions.items() if b in touched})
        new = upsert(old, rows)
        new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{number + 1}")
        known = sorted((versions | dict.fromkeys(touched, number + 1)).items())
        spark.createDataFrame(known, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{table}/versions/{number + 1}")

    return merge


def _versions(spark: SparkSession, table: str, number: int) -> dict[int, int]:
    return {r.bucket: r.version for r in spark.read.parquet(f"{table}/versions/{number}").collect()} if number else {}


def _buckets(spark: SparkSession, table: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    return spark.read.parquet(*[f"{table}/v{v}/bucket={b}" for b, v in sorted(versions.items())])


def merged_table(spark: SparkSession, table: str, number: int) -> DataFrame | None:
    """The table of versioned_merge after `number` batches; null before the first."""
    return _buckets(spark, table, _versions(spark, table, number))
