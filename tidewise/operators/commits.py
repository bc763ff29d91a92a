"""Several tables that change together, and the retry run that needs it.

A `Snapshot` is a folder of versions of named Parquet tables. A commit writes the tables that change into new folders and then creates one small file, `version-N`, that names the folder
of every table; readers take the highest number. The file is created once only, so that of two writers who began at the same version one gets an error (and may
begin again), and a job that dies before it leaves the old state. Folders that no version names go with `clean`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.operators import ingest
from tidewise.sources.shared import file_system, remove


class Conflict(Exception):
    """Another writer has committed since the version that a commit began at."""


class Snapshot:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        fs, where = file_system(self.spark, self.folder)
        if not fs.exists(where):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))

    def tables(self, version: int | None = None) -> tuple[int, dict[str, dict]]:
        """(version, {table: its folder and schema}); (0, {}) before the first commit."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return 0, {}
        return version, json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/version-{version}").first()[1])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        found = self.tables(version)[1][table]
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.folder}/{found['folder']}")

    def commit(self, began_at: int, **changed: DataFrame) -> int:
        """Writes the tables and makes them the version after `began_at`, all or none; the others stay. Conflict if that version is there already."""
        _, known = self.tables(began_at)
        for name, df in changed.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{folder}")
            known[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
        fs, at = file_system(self.spark, f"{self.folder}/version-{began_at + 1}")
        try:
            out = fs.create(at, False)
        except Exception as e:
            if fs.exists(at):
                raise Conflict(f"version {began_at + 1} is there already") from e
            raise
        out.write(bytearray(json.dumps(known).encode()))
        out.close()
        return began_at + 1

    def clean(self, keep: int = 2) -> None:
        """Removes all but the last `keep` versions, and the folders that none of these names."""
        fs, _ = file_system(self.spark, self.folder)
        last = self.versions()[-keep:]
        used = {t["folder"] for v in last for t in self.tables(v)[1].values()}
        for v in self.versions()[:-keep]:
            remove(self.spark, f"{self.folder}/version-{v}")
        for name in {u.split("/")[0] for u in used}:
            for f in fs.listStatus(file_system(self.spark, f"{self.folder}/{name}")[1]):
                if f"{name}/{f.getPath().getName()}" not in used:
                    fs.delete(f.getPath(), True)


def retry(snapshot: Snapshot, extract: Callable[[DataFrame], DataFrame], now: Column, error_type: str | None = None, dry_run: bool = False, version: int = ingest.EXTRACTOR_VERSION) -> DataFrame:
    """Reads the places of open failures again (of one type, if asked for) and commits items, places and failures together; counts by error type: failed, succeeded, items.

    The snapshot has `places` (restaurant_id, …, scraped_at), `items` (restaurant_id, …) and `failures` (restaurant_id, error_type, error_detail, extractor_version, last_attempt_at,
    attempts, resolved). extract takes places and gives (restaurant_id, error_type, items array<struct>); a null error_type is a success, whose items replace those of the
    place, touch it and resolve its failures; another one counts up. A dry run counts the failures and changes nothing.
    """
    began_at, _ = snapshot.tables()
    places, items, failures = (snapshot.read(t, began_at) for t in ("places", "items", "failures"))
    wanted = failures.where(~F.col("resolved"))
    if error_type is not None:
        wanted = wanted.where(F.col("error_type") == error_type)
    kinds = wanted.groupBy("restaurant_id").agg(F.max_by("error_type", "last_attempt_at").alias("was"))
    if dry_run:
        return kinds.groupBy(F.col("was").alias("error_type")).agg(F.count("*").alias("failed"), F.lit(0).cast("long").alias("succeeded"), F.lit(0).cast("long").alias("items"))
    read = extract(places.join(kinds.select("restaurant_id"), "restaurant_id"))
    done = f"{snapshot.folder}/runs/{uuid.uuid4().hex}"
    read.write.parquet(done)  # the provider is asked once
    read = snapshot.spark.read.schema(read.schema).parquet(done)
    good, bad = read.where("error_type is null"), read.where("error_type is not null")
    new_items = good.select("restaurant_id", F.explode("items").alias("x")).select("restaurant_id", "x.*")
    kept = items.join(good.select("restaurant_id").distinct(), "restaurant_id", "left_anti").unionByName(new_items)
    touched = places.join(good.select("restaurant_id").distinct().withColumn("_now", now), "restaurant_id", "left")
    touched = touched.withColumn("scraped_at", F.coalesce("_now", "scraped_at")).select(places.columns)
    again = bad.select("restaurant_id", "error_type", F.lit(None).cast("string").alias("error_detail"), F.lit(version).alias("extractor_version"), now.alias("last_attempt_at"))
    after = ingest.resolve_failures(ingest.upsert_failures(failures, again), good)
    snapshot.commit(began_at, items=kept, places=touched, failures=after)
    counted = kinds.join(read.select("restaurant_id", "error_type", F.size("items").alias("n")), "restaurant_id")
    is_good = F.col("error_type").isNull()
    return counted.groupBy(F.col("was").alias("error_type")).agg(F.count_if(~is_good).alias("failed"), F.count_if(is_good).alias("succeeded"), F.coalesce(F.sum(F.when(is_good, F.col("n"))), F.lit(0)).alias("items"))
