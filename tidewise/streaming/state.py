"""Stateful processors: failures of places with retries that fall due, calls against a budget, and what has been seen.

State lives in RocksDB below the checkpoint of the stream, a key at a time, so a batch reads the keys that it touches and nothing else. A stream that starts again goes on where it
stopped. The rows of one key in one batch are put in order, so a batch should be admitted in bounded pieces (maxFilesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting is back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


class FailureState(StatefulProcessor):
    """Open failures by place. An attempt is a row (restaurant_id, ts, error_type: null for success, extractor_version).

    A failure counts up and keeps type, time and version; a success clears. With `retry_after_ms` a timer on event time gives a row `due` for a failure that is still open then; with `ttl_ms`
    a failure is forgotten when nothing came for so long (by the clock).
    """

    OUT = "restaurant_id long, kind string, attempts long, error_type string, last_attempt_at timestamp, extractor_version int, open boolean"

    def __init__(self, retry_after_ms: int | None = None, ttl_ms: int | None = None):
        self.retry_after_ms, self.ttl_ms = retry_after_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failure = handle.getValueState("failure", "attempts long, error_type string, last_attempt_at timestamp, extractor_version int, due_ms long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        attempts, kind, at, version, due = self.failure.get() if self.failure.exists() else (0, None, None, None, None)
        for r in sorted(rows, key=lambda r: (r["ts"], r["error_type"] is None)):
            at = r["ts"]
            attempts, kind, version = (0, None, None) if r["error_type"] is None else (attempts + 1, r["error_type"], r["extractor_version"])
        if due is not None:
            self.handle.deleteTimer(due)
        if attempts:
            due = None if self.retry_after_ms is None else int(at.timestamp() * 1000) + self.retry_after_ms
            self.failure.update((attempts, kind, at, version, due))
            if due is not None:
                self.handle.registerTimer(due)
        else:
            self.failure.clear()
        yield Row(restaurant_id=key[0], kind="state", attempts=attempts, error_type=kind, last_attempt_at=at, extractor_version=version, open=attempts > 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.failure.exists():
            attempts, kind, at, version, _ = self.failure.get()
            yield Row(restaurant_id=key[0], kind="due", attempts=attempts, error_type=kind, last_attempt_at=at, extractor_version=version, open=True)

    def close(self) -> None:
        pass


class Budget(StatefulProcessor):
    """Admits calls (metro, run, ordinal, ok) in order until as many as `budget` of one run have succeeded; errors don't count, and another run starts anew."""

    OUT = "metro string, run long, ordinal long, used long, admitted boolean"

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "run long, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run, used = self.used.get() if self.used.exists() else (None, 0)
        for r in sorted(rows, key=lambda r: (r["run"], r["ordinal"])):
            if r["run"] != run:
                run, used = r["run"], 0
            admitted = used < self.budget
            used += admitted and r["ok"]
            yield Row(metro=key[0], run=run, ordinal=r["ordinal"], used=used, admitted=admitted)
        self.used.update((run, used))

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """The first row (key, ord) of every key, across batches and restarts: of the first batch with the key the one with the smallest ord. With `ttl_ms` keys are forgotten after that time."""

    OUT = "key long, ord long"

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ord long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            first = min(r["ord"] for r in rows)
            self.seen.update((first,))
            yield Row(key=key[0], ord=first)

    def close(self) -> None:
        pass


def failure_states(attempts: DataFrame, retry_after_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The stream of states of places from a stream of attempts; with retry_after_ms the attempts need a watermark on ts. Start it within state_store."""
    mode = "eventTime" if retry_after_ms is not None else "processingTime" if ttl_ms is not None else "none"
    return attempts.groupBy("restaurant_id").transformWithState(FailureState(retry_after_ms, ttl_ms), FailureState.OUT, "update", mode)


def blocked(states: DataFrame, version: int) -> DataFrame:
    """Places whose last state (by batch) is an open failure of this version or a later one: what a run leaves out. A new version tries all of them again."""
    last = states.where("kind = 'state'").groupBy("restaurant_id").agg(F.max_by(F.struct("open", "extractor_version"), "batch").alias("x"))
    return last.where(F.col("x.open") & (F.col("x.extractor_version") >= version)).select("restaurant_id")


def within_budget(calls: DataFrame, budget: int) -> DataFrame:
    """The stream of calls with used and admitted."""
    return calls.groupBy("metro").transformWithState(Budget(budget), Budget.OUT, "update", "none")


def first_seen(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The stream of the first (key, ord) of each key."""
    return rows.groupBy("key").transformWithState(FirstSeen(ttl_ms), FirstSeen.OUT, "update", "none" if ttl_ms is None else "processingTime")


def run_through(stream: DataFrame, table: str, checkpoint: str) -> int:
    """Works through what is there and appends every batch's rows, with its number, to the Parquet table; a batch that comes again replaces its own. Gives the number of rows processed."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    with state_store(stream.sparkSession):
        query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return sum(p.get("numInputRows", 0) for p in query.recentProgress)
