"""Operational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(restaurants: DataFrame, items: DataFrame) -> DataFrame:
    """Places and items, places without items included."""
    per = items.groupBy("restaurant_id").agg(F.count("*").alias("n"))
    return restaurants.join(per, "restaurant_id", "left").agg(F.countDistinct("restaurant_id").alias("n_restaurants"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))


def failure_breakdown(failures: DataFrame) -> DataFrame:
    """Failures by type with the oldest extractor version, most frequent first."""
    return failures.groupBy("error_type").agg(F.count("*").alias("n"), F.min("extractor_version").alias("min_version")).orderBy(F.col("n").desc(), "error_type")


def retryable(failures: DataFrame, restaurants: DataFrame, error_type: str | None = None) -> DataFrame:
    """Unresolved failures with their places, of one type if given."""
    open_ones = failures.where(~F.col("resolved"))
    if error_type is not None:
        open_ones = open_ones.where(F.col("error_type") == error_type)
    return open_ones.join(restaurants, "restaurant_id")


def retry_report(failures: DataFrame, restaurants: DataFrame, error_type: str | None = None) -> DataFrame:
    """What a retry would work on, without doing it: error types with their numbers, most common first (place)."""
    counted = retryable(failures, restaurants, error_type).groupBy("error_type").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "error_type")))  # one row per error type


def search_totals(plan: DataFrame, free_per_month: int = 8000) -> DataFrame:
    """One row over all metros of a search plan: points, core and full searches, months of free searches."""
    whole = plan.agg(*[F.sum(c).alias(c) for c in ("points", "core_searches", "full_searches")])
    return whole.withColumn("months", F.floor(F.col("core_searches") / free_per_month) + 1)


def coverage(items: DataFrame, by: str) -> DataFrame:
    """Share of items with a price per group, and whether the group counts as a real list: 30 % or three of them."""
    share = items.groupBy(by).agg(F.count("*").alias("n_items"), F.count("price").alias("n_priced"))
    return share.withColumns({"share": F.col("n_priced") / F.col("n_items"), "accepted": (F.col("n_priced") / F.col("n_items") >= 0.3) | (F.col("n_priced") >= 3)})


def search_plan(grid: DataFrame, core_types: int = 12, full_types: int = 34, free_per_month: int = 8000) -> DataFrame:
    """Grid points and searches per metro, and months of free searches for the core types."""
    per = grid.groupBy("metro").agg(F.count("*").alias("points"))
    core = F.col("points") * core_types
    return per.withColumns({"core_searches": core, "full_searches": F.col("points") * full_types, "months": F.floor(core / free_per_month) + 1})


def menu_sections(items: DataFrame) -> DataFrame:
    """Items per place and category, those without one under Other."""
    return items.groupBy("restaurant_id", F.coalesce("category", F.lit("Other")).alias("section")).agg(F.count("*").alias("n_items"), F.min("price").alias("min_price"))


def progress(done: DataFrame, total: int) -> DataFrame:
    """Rate per hour and per cent complete per group of (key, searches, seconds)."""
    return done.select("*", F.round(F.col("searches") * 3600.0 / F.nullif(F.col("seconds"), F.lit(0)), 1).alias("per_hour"), F.round(100.0 * F.col("searches") / total, 1).alias("percent"))


def method_counts(outcomes: DataFrame) -> DataFrame:
    """Sites and items by the method that read them, and sites without items."""
    return outcomes.groupBy("method").agg(F.count("*").alias("n_sites"), F.sum("n_items").cast("long").alias("n_items"), F.count_if(F.col("n_items") == 0).alias("n_empty"))
