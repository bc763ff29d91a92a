"""Set-based ingestion: what to look up, what is new, and the tables after it. Every step takes and returns whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTRACTOR_VERSION = 4
FRESH_DAYS = 30


def searches(grid: DataFrame, types: DataFrame) -> DataFrame:
    """Every grid point with every food type (type_no from 0, food_type), in order: ordinal = point * number of types + type."""
    per_metro = Window.partitionBy("metro").orderBy("row", "col")
    points = grid.withColumn("point_no", F.row_number().over(per_metro) - 1)
    listed = types.agg(F.array_sort(F.collect_list(F.struct("type_no", "food_type"))).alias("types"))  # one value: the types of all searches
    each = points.withColumn("types", listed.scalar()).select("metro", "point_no", "lat", "lng", "label", F.size("types").alias("n"), F.explode("types").alias("t"))
    return each.select("metro", "point_no", "lat", "lng", "label", "t.*", (F.col("point_no") * F.col("n") + F.col("t.type_no")).alias("ordinal"))


def remaining(work: DataFrame, checkpoints: DataFrame, budget: int | None = None) -> DataFrame:
    """Searches of each metro from its checkpoint on (ordinal, null or completed: from the start), at most `budget` of them per run."""
    start = F.when(F.col("completed_at").isNull(), F.col("next_ordinal")).otherwise(0)
    left = work.join(checkpoints.select("metro", "next_ordinal", "completed_at"), "metro", "left").where(F.col("ordinal") >= F.coalesce(start, F.lit(0)))
    left = left.withColumn("run_no", F.row_number().over(Window.partitionBy("metro").orderBy("ordinal"))).drop("next_ordinal", "completed_at")
    return left if budget is None else left.where(F.col("run_no") <= budget)


def save_checkpoints(done: DataFrame, work: DataFrame, now: Column) -> DataFrame:
    """metro, next_ordinal, searches, completed_at after the searches `done`."""
    total = work.groupBy("metro").agg(F.max("ordinal").alias("last"))
    per = done.groupBy("metro").agg((F.max("ordinal") + 1).alias("next_ordinal"), F.count("*").alias("searches"))
    return per.join(total, "metro").select("metro", "next_ordinal", "searches", F.when(F.col("next_ordinal") > F.col("last"), now).alias("completed_at"))


def first_seen(found: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order."""
    row = F.min_by(F.struct(*found.columns), F.col(order))
    return found.groupBy(key).agg(row.alias("_r")).select("_r.*")


def insert_new(old: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """old and the rows of found with unknown keys, one each."""
    return old.unionByName(found.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def due(restaurants: DataFrame, failures: DataFrame, as_of: Column, version: int = EXTRACTOR_VERSION) -> DataFrame:
    """Places with a website, not read within 30 days, and without an open failure of the current version."""
    fresh = F.coalesce(F.col("scraped_at") > as_of - F.expr(f"INTERVAL {FRESH_DAYS} DAYS"), F.lit(False))
    blocked = failures.where(~F.col("resolved") & (F.col("extractor_version") >= version)).select("restaurant_id")
    return restaurants.where(F.col("website_url").isNotNull() & ~fresh).join(blocked, "restaurant_id", "left_anti")


def replace_items(old: DataFrame, new: DataFrame, key: str = "restaurant_id") -> DataFrame:
    """old with all rows of the keys in new replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_failures(old: DataFrame, new: DataFrame) -> DataFrame:
    """At most one open failure per place: another attempt counts up and replaces type, detail and version; resolved ones stay."""
    detail = F.substring("error_detail", 1, 1000)
    latest = new.groupBy("restaurant_id").agg(F.count("*").alias("_more"), F.max_by(F.struct("error_type", detail.alias("error_detail"), "extractor_version", "last_attempt_at"), "last_attempt_at").alias("_new"))
    open_ones = old.where(~F.col("resolved")).withColumn("_no", F.row_number().over(Window.partitionBy("restaurant_id").orderBy(F.col("last_attempt_at").desc()))).where("_no = 1").drop("_no")
    merged = open_ones.join(latest, "restaurant_id", "full")
    fields = [F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in ("error_type", "error_detail", "extractor_version", "last_attempt_at")]
    merged = merged.select("restaurant_id", *fields, (F.coalesce("attempts", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("attempts"), F.lit(False).alias("resolved"))
    return old.where("resolved").select(merged.columns).unionByName(merged)


def resolve_failures(failures: DataFrame, succeeded: DataFrame) -> DataFrame:
    """failures with those of the places in succeeded marked as resolved."""
    done = succeeded.select("restaurant_id").distinct().withColumn("_done", F.lit(True))
    return failures.join(done, "restaurant_id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).select(failures.columns)


def upsert_patterns(old: DataFrame, learned: DataFrame) -> DataFrame:
    """Patterns by (platform_type, detection_rule): a new one counts 1, another success counts up and replaces the selectors."""
    both = old.withColumn("_new", F.lit(0)).unionByName(learned.withColumn("_new", F.lit(1)))
    return both.groupBy("platform_type", "detection_rule").agg(F.max_by("selectors", F.struct("_new", "last_used_at")).alias("selectors"), F.sum("success_count").alias("success_count"), F.max("last_used_at").alias("last_used_at"))


def best_pattern(patterns: DataFrame) -> DataFrame:
    """The most successful pattern of each platform."""
    return patterns.groupBy("platform_type").agg(F.max_by("selectors", F.struct("success_count", "detection_rule")).alias("selectors"), F.max("success_count").alias("success_count"))


def failure_type(method: Column, platform: Column, error: Column | None = None) -> Column:
    """Why a read gave no items; error is what ended it early, `timeout` or any other text, null if nothing did."""
    ended = F.lit(None).cast("string") if error is None else F.when(error == "timeout", "timeout").when(error.isNotNull(), "exception")
    return F.when(ended.isNotNull(), ended).when(method == "free_exhausted", "free_only_skip").when(platform == "unknown", "bot_blocked").when((platform == "custom") & (method == "none"), "js_spa_empty").otherwise("extraction_fail")


def merge_attempts(old: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Open failures (restaurant_id, attempts, error_type, last_attempt_at, open) after attempts (restaurant_id, ts, error_type: null for success).

    A failure counts up and a success clears, in the order of time; the attempts of one batch are newer than those before it. Rows of
    the batch are summed up before they are shuffled, two rows a place.
    """
    ok = F.max(F.when(F.col("error_type").isNull(), F.col("ts")))
    cleared = rows.groupBy("restaurant_id").agg(ok.alias("ok_at"), F.max("ts").alias("at"))
    after = rows.where(F.col("error_type").isNotNull()).join(cleared, "restaurant_id").where(F.col("ok_at").isNull() | (F.col("ts") > F.col("ok_at")))
    failed = after.groupBy("restaurant_id").agg(F.count("*").alias("more"), F.max_by("error_type", "ts").alias("kind"))
    new = cleared.join(failed, "restaurant_id", "left").select("restaurant_id", "ok_at", "at", F.coalesce("more", F.lit(0)).alias("more"), "kind")
    if old is None:
        old = rows.sparkSession.createDataFrame([], "restaurant_id long, attempts long, error_type string, last_attempt_at timestamp, open boolean")
    both = old.join(new, "restaurant_id", "full")
    attempts = F.when(F.col("ok_at").isNull(), F.coalesce("attempts", F.lit(0))).otherwise(0) + F.coalesce("more", F.lit(0))
    kind = F.when(attempts > 0, F.coalesce("kind", "error_type"))
    return both.select("restaurant_id", attempts.alias("attempts"), kind.alias("error_type"), F.coalesce("at", "last_attempt_at").alias("last_attempt_at"), (attempts > 0).alias("open"))
