"""Subscriptions, favourites and the checks that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_premium(as_of: Column) -> Column:
    """Active and either for life or a trial that has an end after as_of."""
    trial = (F.col("tier") == "trial") & F.col("expires_at").isNotNull() & (F.col("expires_at") > as_of)
    return F.col("is_active") & ((F.col("tier") == "lifetime") | trial)


def days_remaining(as_of: Column) -> Column:
    """Whole days until expires_at, 0 at least; null without an end."""
    seconds = F.unix_timestamp("expires_at") - F.unix_timestamp(as_of)
    return F.when(F.col("expires_at").isNotNull(), F.greatest(F.lit(0), F.floor(seconds / 86400)))


def latest_active(subscriptions: DataFrame) -> DataFrame:
    """The newest active row of each user; it alone decides, even when it has run out."""
    active = subscriptions.where("is_active")
    row = F.max_by(F.struct(*active.columns), F.struct("created_at", "external_id"))
    return active.groupBy("user_id").agg(row.alias("r")).select("r.*")


def subscription_status(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    return latest_active(subscriptions).select("user_id", "tier", "created_at", is_premium(as_of).alias("premium"), days_remaining(as_of).alias("days_remaining"))


def redeem(subscriptions: DataFrame, receipts: DataFrame, now: Column) -> DataFrame:
    """subscriptions after lifetime receipts (user_id, external_id): known ids are refused, a user's other rows end."""
    return _switch(subscriptions, receipts.dropDuplicates(["external_id"]).join(subscriptions.select("external_id"), "external_id", "left_anti"), now)


def grant_lifetime(users: DataFrame, subscriptions: DataFrame, emails: DataFrame, now: Column) -> DataFrame:
    """subscriptions after lifetime grants to the users (user_id, email) named by normalised e-mail; unknown addresses get none."""
    named = emails.select(F.trim(F.lower("email")).alias("email"))
    chosen = users.join(named, "email", "left_semi").select("user_id").distinct()
    return _switch(subscriptions, chosen.withColumn("external_id", F.lit(None).cast(subscriptions.schema["external_id"].dataType)), now)


def _switch(subscriptions: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """subscriptions with a lifetime row for each of fresh (user_id, external_id), whose users' other rows end."""
    ended = subscriptions.join(fresh.select("user_id").distinct().withColumn("_new", F.lit(True)), "user_id", "left")
    ended = ended.withColumn("is_active", F.col("is_active") & F.col("_new").isNull()).select(subscriptions.columns)
    new = fresh.select("user_id", F.lit("lifetime").alias("tier"), "external_id", now.alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(True).alias("is_active"))
    return ended.unionByName(new)


def sign_up(users: DataFrame, subscriptions: DataFrame, applicants: DataFrame, now: Column, trial_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(users, subscriptions) with applicants (user_id, email) whose normalised address is valid and new, and a trial for each."""
    email = F.trim(F.lower("email"))
    valid = applicants.withColumn("email", email).where(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")).dropDuplicates(["email"])
    new = valid.join(users.select("email"), "email", "left_anti").select(users.columns)
    trial = new.select("user_id", F.lit("trial").alias("tier"), F.lit(None).cast("long").alias("external_id"), now.alias("created_at"), (now + F.expr(f"INTERVAL {trial_days} DAYS")).alias("expires_at"), F.lit(True).alias("is_active"))
    return users.unionByName(new), subscriptions.unionByName(trial)


def upsert_favourites(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (user_id, item_id): a new note replaces the old one unless it is null; the first date stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "created_at", "favourite_id")
    return both.groupBy("user_id", "item_id").agg(
        F.min_by("favourite_id", order).alias("favourite_id"), F.max_by(F.col("note"), F.when(F.col("note").isNotNull(), order)).alias("note"), F.min_by("created_at", order).alias("created_at")
    )


def remove_favourites(favourites: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the rows (favourite_id, user_id) of gone; a foreign id removes nothing."""
    return favourites.join(gone, ["favourite_id", "user_id"], "left_anti")


def favourite_items(favourites: DataFrame, items: DataFrame, user_id=None) -> DataFrame:
    """Favourites with their items, newest first by `place` within a user."""
    mine = favourites if user_id is None else favourites.where(F.col("user_id") == user_id)
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "favourite_id")
    return mine.withColumn("place", F.row_number().over(newest)).join(items, "item_id")


def last_locations(fixes: DataFrame) -> DataFrame:
    """The latest position (lat, lng) of each user from fixes (user_id, ts, lat, lng)."""
    return fixes.groupBy("user_id").agg(F.max_by(F.struct("lat", "lng"), "ts").alias("p"), F.max("ts").alias("ts")).select("user_id", "ts", "p.lat", "p.lng")
