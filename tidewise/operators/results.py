"""A store of search results that expire: written by searches, read by their key, cleared by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import text as tx
from tidewise.sources.shared import file_system, remove

_ROW = "key string, results string, stored_at timestamp, expires_at timestamp, expires_on date"


def result_key(query: Column, lat: Column, lng: Column, radius: Column, sort: Column, limit: Column) -> Column:
    """The key of a search, with its order and limit: results in another order, or fewer of them, are others."""
    return F.concat_ws("_", tx.cache_key(query, lat, lng, radius), sort, limit.cast("string"))


class ResultStore:
    """A Parquet folder by day of expiry, so that reads open no expired day and expired days go as folders. Writes add rows; of a key the one stored last counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, rows: DataFrame, hold: str = "INTERVAL 1 DAY") -> None:
        """Stores rows (key, results as JSON, stored_at) for `hold` from then."""
        expires = F.col("stored_at") + F.expr(hold)
        dated = rows.select("key", "results", "stored_at", expires.alias("expires_at"), F.to_date(expires).alias("expires_on"))
        dated.repartition("expires_on", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("append").partitionBy("expires_on").parquet(self.folder)

    def rows(self) -> DataFrame:
        fs, where = file_system(self.spark, self.folder)
        return self.spark.read.schema(_ROW).parquet(self.folder) if fs.exists(where) else self.spark.createDataFrame([], _ROW)

    def get(self, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
        """requests (key, …) with results and state: hit, expired or miss."""
        now = F.lit(as_of)
        known = self.rows().groupBy("key").agg(F.max_by(F.struct("results", "expires_at"), F.struct("stored_at", "results")).alias("last"))
        holds = F.col("last.expires_at") > now
        found = requests.join(known, "key", "left").withColumns({"results": F.when(holds, F.col("last.results")), "state": F.when(holds, "hit").when(F.col("last").isNotNull(), "expired").otherwise("miss")})
        return found.drop("last")

    def valid(self, as_of: dt.datetime) -> DataFrame:
        """Rows that still hold, from the days that can have some."""
        return self.rows().where((F.col("expires_on") >= F.lit(as_of.date())) & (F.col("expires_at") > F.lit(as_of)))

    def clear(self, as_of: dt.datetime) -> list[str]:
        """Removes the days that are over; gives their names."""
        fs, where = file_system(self.spark, self.folder)
        days = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        over = sorted(d for d in days if d.startswith("expires_on=") and d.removeprefix("expires_on=") < as_of.date().isoformat())
        for day in over:
            remove(self.spark, f"{self.folder}/{day}")
        return over


def decoded(rows: DataFrame, schema: str) -> DataFrame:
    """rows with results read back from JSON."""
    return rows.withColumn("results", F.from_json("results", schema))
