import pytest
from pyspark.sql import functions as F

from tidewise.operators.ingest import insert_new, merge_attempts
from tidewise.streaming import jobs


def written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_debounce_is_the_same_for_table_and_stream(spark, tmp_path):
    schema = "user_id int, ts timestamp, text string"
    at = lambda ms: f"2024-01-01 00:00:{ms / 1000:06.3f}"
    rows = [(1, at(0), "h"), (1, at(10), "ho"), (1, at(200), "hot"), (1, at(900), "hot p"), (2, at(100), "ta"), (2, at(390), "tac"), (2, at(700), "taco")]
    table = spark.createDataFrame(rows, "user_id int, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    want = sorted((r.user_id, r.text, r.n_keys) for r in jobs.debounced(table).collect())
    assert want == [(1, "hot", 2), (1, "hot p", 1), (2, "tac", 2), (2, "taco", 1)]
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(9, "2024-01-01 01:00:00", "zz")], "user_id int, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.debounced(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.user_id, r.text, r.n_keys) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.user_id != 9) == want


def test_ingest_resumes_at_its_checkpoint(spark, tmp_path):
    schema, table = "ordinal int, food_type string", f"{tmp_path}/places"
    merge_rows = jobs.versioned_merge(spark, table, "place_id", lambda old, rows: rows if old is None else insert_new(old, rows, "place_id"))
    seen = []

    def merge(rows, number):
        seen.append((number, sorted(r.place_id for r in rows.collect())))
        merge_rows(rows, number)

    look_up = lambda rows: rows.select(F.explode(F.array((F.col("ordinal") % 3), F.col("ordinal"))).alias("place_id"), "food_type")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.ingest_stream(stream, look_up, merge, f"{tmp_path}/cp").awaitTermination()

    written(spark, tmp_path / "in", [(4, "a"), (5, "b")], schema)
    run()
    written(spark, tmp_path / "in", [(6, "a"), (7, "c")], schema)
    run()
    run()
    assert seen == [(0, [1, 2, 4, 5]), (1, [0, 1, 6, 7])]
    assert sorted(r.place_id for r in jobs.merged_table(spark, table, 2).collect()) == [0, 1, 2, 4, 5, 6, 7]


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    """A small batch leaves the files of other buckets, and one that comes again changes nothing."""
    table = f"{tmp_path}/t"
    merge = jobs.versioned_merge(spark, table, "k", lambda old, rows: rows if old is None else old.join(rows, "k", "left_anti").unionByName(rows), buckets=8)
    merge(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), 0)
    for _ in range(2):
        merge(spark.createDataFrame([(3, "b")], "k long, v string"), 1)
        got = {r.k: r.v for r in jobs.merged_table(spark, table, 2).collect()}
        assert got == {k: "b" if k == 3 else "a" for k in range(100)}
    assert len(list((tmp_path / "t" / "v1").glob("bucket=*"))) == 8 and len(list((tmp_path / "t" / "v2").glob("bucket=*"))) == 1
    assert jobs.merged_table(spark, table, 0) is None


def test_failure_state_over_batches(spark, tmp_path):
    schema = "restaurant_id long, ts timestamp, error_type string"
    t = lambda m: __import__("datetime").datetime(2024, 1, 1, 0, m)
    written(spark, tmp_path / "in", [(1, t(1), "timeout"), (1, t(2), "timeout"), (2, t(1), "x"), (2, t(3), None)], schema)
    state: dict = {}
    merge = jobs.versioned_merge(spark, f"{tmp_path}/table", "restaurant_id", merge_attempts, buckets=2)

    def keep(rows, number):
        merge(rows, number)
        state.update({r.restaurant_id: (r.attempts, r.error_type, r.open) for r in jobs.merged_table(spark, f"{tmp_path}/table", number + 1).collect()})

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    run()
    assert state == {1: (2, "timeout", True), 2: (0, None, False)}
    written(spark, tmp_path / "in", [(1, t(5), "blocked"), (2, t(6), "y")], schema)
    run()
    assert state == {1: (3, "blocked", True), 2: (1, "y", True)}


def test_views_of_ingestion(spark):
    from tidewise.operators import ingest

    old = spark.createDataFrame([(1, "timeout", "d", 3, None, 2, False), (2, "x", "d", 4, None, 1, True)], "restaurant_id long, error_type string, error_detail string, extractor_version int, last_attempt_at timestamp, attempts int, resolved boolean")
    new = spark.createDataFrame([(1, "blocked", "e" * 2000, 4, None, 1, False), (2, "y", "e", 4, None, 1, False)], old.schema).withColumn("last_attempt_at", F.current_timestamp())
    got = sorted((r.restaurant_id, r.error_type, r.attempts, r.resolved, len(r.error_detail)) for r in ingest.upsert_failures(old, new).collect())
    assert got == [(1, "blocked", 3, False, 1000), (2, "x", 1, True, 1), (2, "y", 1, False, 1)]
    assert [r.resolved for r in ingest.resolve_failures(old, new.select("restaurant_id")).collect()] == [True, True]
    with pytest.raises(Exception):
        ingest.first_seen(old, "no_such_column", "attempts").collect()
