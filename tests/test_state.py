import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewise.streaming import state


def put(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("ts", F.to_timestamp("ts")) if "ts" in df.columns else df
    df.coalesce(1).write.mode("append").parquet(str(path))


ATTEMPT = "restaurant_id long, ts string, error_type string, extractor_version int"
AT = ATTEMPT.replace("ts string", "ts timestamp")


def last(spark, table):
    rows = spark.read.parquet(table).where("kind = 'state'").orderBy("batch").collect()
    return {r.restaurant_id: (r.attempts, r.error_type, r.extractor_version, r.open) for r in rows}


def test_failures_across_restarts(spark, tmp_path):
    table, cp = f"{tmp_path}/table", f"{tmp_path}/cp"

    def run():
        stream = spark.readStream.schema(AT).parquet(f"{tmp_path}/in")
        state.run_through(state.failure_states(stream), table, cp)

    put(spark, tmp_path / "in", [(1, "2024-01-01 00:00:02", "timeout", 4), (1, "2024-01-01 00:00:01", None, 4), (2, "2024-01-01 00:00:01", "bot_blocked", 3), (3, "2024-01-01 00:00:01", "timeout", 4)], ATTEMPT)
    run()
    assert last(spark, table) == {1: (1, "timeout", 4, True), 2: (1, "bot_blocked", 3, True), 3: (1, "timeout", 4, True)}
    put(spark, tmp_path / "in", [(1, "2024-01-01 01:00:00", "exception", 5), (3, "2024-01-01 01:00:00", None, 5)], ATTEMPT)
    run()
    run()
    assert last(spark, table) == {1: (2, "exception", 5, True), 2: (1, "bot_blocked", 3, True), 3: (0, None, None, False)}
    states = spark.read.parquet(table)
    assert [sorted(r[0] for r in state.blocked(states, v).collect()) for v in (3, 4, 5, 6)] == [[1, 2], [1], [1], []]


def test_retries_fall_due_by_event_time(spark, tmp_path):
    table = f"{tmp_path}/table"

    def run():
        stream = spark.readStream.schema(AT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
        state.run_through(state.failure_states(stream, retry_after_ms=60_000), table, f"{tmp_path}/cp")

    put(spark, tmp_path / "in", [(1, "2024-01-01 00:00:00", "timeout", 4), (2, "2024-01-01 00:00:00", "timeout", 4)], ATTEMPT)
    run()
    put(spark, tmp_path / "in", [(2, "2024-01-01 00:00:30", None, 4), (9, "2024-01-01 00:05:00", None, 4)], ATTEMPT)
    run()
    put(spark, tmp_path / "in", [(9, "2024-01-01 00:06:00", None, 4)], ATTEMPT)
    run()
    due = spark.read.parquet(table).where("kind = 'due'").collect()
    assert [(r.restaurant_id, r.attempts, r.last_attempt_at) for r in due] == [(1, 1, dt.datetime(2024, 1, 1))]  # 2 was cleared before


def test_budget_counts_successes_of_a_run(spark, tmp_path):
    schema = "metro string, run long, ordinal long, ok boolean"

    def run():
        state.run_through(state.within_budget(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3), f"{tmp_path}/table", f"{tmp_path}/cp")

    put(spark, tmp_path / "in", [("a", 1, i, i % 2 == 0) for i in range(4)] + [("b", 1, 0, True)], schema)
    run()
    put(spark, tmp_path / "in", [("a", 1, i, i % 2 == 0) for i in range(4, 8)] + [("a", 2, 0, True)], schema)
    run()
    rows = spark.read.parquet(f"{tmp_path}/table").collect()
    assert sorted((r.metro, r.run, r.ordinal) for r in rows if r.admitted) == [("a", 1, 0), ("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("a", 1, 4), ("a", 2, 0), ("b", 1, 0)]


@pytest.mark.parametrize("again", [False, True])
def test_first_seen_once_over_batches_and_restarts(spark, tmp_path, again):
    schema = "key long, ord long"
    batches = [[(1, 5), (1, 3), (2, 9)], [(1, 1), (3, 4), (3, 4)], [(2, 2), (4, 8)]]
    for batch in batches:
        put(spark, tmp_path / "in", batch, schema)
        if again:
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            state.run_through(state.first_seen(stream), f"{tmp_path}/table", f"{tmp_path}/cp")
    if not again:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        state.run_through(state.first_seen(stream, ttl_ms=3_600_000), f"{tmp_path}/table", f"{tmp_path}/cp")
    got = sorted((r.key, r.ord) for r in spark.read.parquet(f"{tmp_path}/table").collect())
    assert got == [(1, 3), (2, 9), (3, 4), (4, 8)]
