import datetime as dt
import threading
import time

from pyspark.sql import functions as F

from tidewise.operators.providers import call_each, in_flight
from tidewise.operators.results import ResultStore, decoded, result_key


def test_calls_in_flight_are_bounded_and_late_ones_given_up():
    now, most, lock = [0], [0], threading.Lock()

    def call(row):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(30 if row["i"] == 3 else 0.02)
        with lock:
            now[0] -= 1
        if row["i"] % 5 == 1:
            raise ValueError("no")
        return {"n": row["i"]}

    began = time.monotonic()
    got = {r["i"]: (x, kind, detail) for r, x, kind, detail in in_flight(({"i": i} for i in range(40)), call, 4, 2.0)}
    assert len(got) == 40 and most[0] <= 5 and time.monotonic() - began < 15
    assert got[3][1] == "timeout" and got[11] == (None, "exception", "ValueError: no") and got[12] == ({"n": 12}, None, None)


def test_rows_come_out_once(spark):
    def call(row):
        if row["id"] == 7:
            time.sleep(60)
        if row["id"] % 10 == 4:
            raise RuntimeError("x" * 5000)
        return {"double": row["id"] * 2, "note": None}

    df = spark.range(60).repartition(3).withColumn("error_type", F.lit("old"))
    rows = {r.id: r for r in call_each(df, call, "double long, note string", at_once=3, deadline_s=3.0).collect()}
    assert len(rows) == 60 and rows[7].error_type == "timeout" and rows[14].error_type == "exception" and len(rows[14].error_detail) == 1000
    assert all(r.result.double == 2 * i and r.error_type is None for i, r in rows.items() if i != 7 and i % 10 != 4)
    assert call_each(spark.range(0), call, "double long, note string").collect() == []


def test_results_hit_miss_expire_and_repeat(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    put = lambda rows: store.put(spark.createDataFrame(rows, "key string, results string, stored_at timestamp"))
    ask = lambda when: {r.key: (r.state, r.results) for r in store.get(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), when).collect()}
    assert ask(at(1)) == {k: ("miss", None) for k in "abc"} and store.clear(at(1)) == []
    put([("a", '{"n": 1}', at(1)), ("b", '{"n": 2}', at(1, 12))])
    assert ask(at(2, 6)) == {"a": ("expired", None), "b": ("hit", '{"n": 2}'), "c": ("miss", None)}
    put([("a", '{"n": 3}', at(2, 1))])
    assert ask(at(2, 6))["a"] == ("hit", '{"n": 3}')
    assert store.clear(at(3)) == ["expires_on=2024-01-02"] and ask(at(3, 0))["a"][0] == "hit" and ask(at(3, 0))["b"][0] == "miss"
    assert [r.results.n for r in decoded(store.valid(at(3, 0)), "n int").collect()] == [3]


def test_keys_tell_order_and_limit(spark):
    df = spark.createDataFrame([("q", 1.0, 2.0, 500.0, "distance", 20), ("q", 1.0, 2.0, 500.0, "rating", 20), ("q", 1.0, 2.0, 500.0, "distance", 10)], "q string, a double, b double, r double, s string, n int")
    assert df.select(result_key(*map(F.col, "qabrsn"))).distinct().count() == 3
