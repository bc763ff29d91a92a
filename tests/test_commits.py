import pytest
from pyspark.sql import functions as F

from tidewise.operators import commits
from tidewise.operators.commits import Conflict, Snapshot, retry

now = lambda: F.lit("2024-02-01 00:00:00").cast("timestamp")
FAILURES = "restaurant_id long, error_type string, error_detail string, extractor_version int, last_attempt_at timestamp, attempts long, resolved boolean"


def start(spark, folder):
    snapshot = Snapshot(spark, str(folder))
    places = spark.range(1, 7).select(F.col("id").alias("restaurant_id"), F.concat(F.lit("Place "), "id").alias("name"), F.lit(None).cast("timestamp").alias("scraped_at"))
    items = spark.createDataFrame([(1, "old"), (2, "old"), (6, "old")], "restaurant_id long, name string")
    rows = [(1, "timeout", None, 3, 1, False), (2, "timeout", None, 3, 2, False), (3, "bot_blocked", None, 3, 1, False), (4, "timeout", None, 3, 1, True)]
    failures = spark.createDataFrame(rows, "restaurant_id long, error_type string, error_detail string, extractor_version int, attempts long, resolved boolean")
    failures = failures.withColumn("last_attempt_at", F.lit("2024-01-01").cast("timestamp")).select(*[c.split()[0] for c in FAILURES.split(", ")])
    assert snapshot.commit(0, places=places, items=items, failures=failures) == 1
    return snapshot


def extract(places):
    """Place 2 fails again, the others give an item."""
    found = F.array(F.struct(F.concat(F.lit("new "), F.col("restaurant_id").cast("string")).alias("name")))
    failed = F.col("restaurant_id") == 2
    return places.select("restaurant_id", F.when(failed, "exception").alias("error_type"), F.when(~failed, found).otherwise(F.slice(found, 1, 0)).alias("items"))


def state(snapshot, version=None):
    items = sorted((r.restaurant_id, r.name) for r in snapshot.read("items", version).collect())
    failures = sorted((r.restaurant_id, r.error_type, r.attempts, r.resolved) for r in snapshot.read("failures", version).collect())
    return items, failures, sorted(r.restaurant_id for r in snapshot.read("places", version).where("scraped_at is not null").collect())


def test_retry_changes_all_tables_together(spark, tmp_path):
    snapshot = start(spark, tmp_path / "s")
    before = state(snapshot)
    assert [tuple(r) for r in retry(snapshot, extract, now(), "timeout", dry_run=True).collect()] == [("timeout", 2, 0, 0)]
    assert snapshot.versions() == [1]
    assert [tuple(r) for r in retry(snapshot, extract, now(), "timeout").collect()] == [("timeout", 1, 1, 1)]
    items, failures, touched = state(snapshot)
    assert items == [(1, "new 1"), (2, "old"), (6, "old")] and touched == [1]
    assert failures == [(1, "timeout", 1, True), (2, "exception", 3, False), (3, "bot_blocked", 1, False), (4, "timeout", 1, True)]
    assert state(snapshot, 1) == before
    retry(snapshot, extract, now())
    assert state(snapshot)[0] == [(1, "new 1"), (2, "old"), (3, "new 3"), (6, "old")] and snapshot.versions() == [1, 2, 3]
    snapshot.clean(1)
    assert snapshot.versions() == [3] and state(snapshot)[2] == [1, 3]


@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_crash_between_the_writes_leaves_the_old_state(spark, tmp_path, monkeypatch, at):
    snapshot = start(spark, tmp_path / "s")
    before, calls = state(snapshot), []

    def crash(*_):
        calls.append(1)
        if len(calls) == at:
            raise RuntimeError("lost")
        return real()

    real = __import__("uuid").uuid4
    monkeypatch.setattr(commits.uuid, "uuid4", crash)
    with pytest.raises(RuntimeError):
        retry(snapshot, extract, now())
    monkeypatch.undo()
    assert state(snapshot) == before and snapshot.versions() == [1]
    retry(snapshot, extract, now())
    assert snapshot.versions() == [1, 2] and (3, "new 3") in state(snapshot)[0]


def test_of_two_writers_one_has_to_begin_again(spark, tmp_path):
    snapshot = start(spark, tmp_path / "s")
    began_at, _ = snapshot.tables()
    items = snapshot.read("items")
    assert snapshot.commit(began_at, items=items.where("restaurant_id = 1")) == 2
    with pytest.raises(Conflict):
        snapshot.commit(began_at, items=items.where("restaurant_id = 2"))
    assert [r.restaurant_id for r in snapshot.read("items").collect()] == [1] and snapshot.read("places").count() == 6
