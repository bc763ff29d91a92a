"""Calls of slow services from tasks: so many at once in each partition, a deadline for each call, failures as rows."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that comes out, and of one that came in that are Python objects at the same time.
_TOGETHER, _AT_A_TIME = 256, 16


def in_flight(rows: Iterable[dict], call: Callable[[dict], dict], at_once: int, deadline_s: float) -> Iterator[tuple[dict, dict | None, str | None, str | None]]:
    """(row, result, error type, detail) as calls end, with at most `at_once` rows under way; rows are taken as places come free.

    A call that is late is given up as `timeout` and its place goes to the next row; what it gives later is not heard. One that raises is an `exception`. Calls run in daemon threads, so
    one that never ends holds its thread, but neither the others nor the end of the worker.
    """
    ended: queue.Queue = queue.Queue()

    def work(no: int, row: dict) -> None:
        try:
            ended.put((no, call(row), None, None))
        except Exception as e:
            ended.put((no, None, "exception", f"{type(e).__name__}: {e}"[:1000]))

    source, under_way, no, more = iter(rows), {}, 0, True
    while more or under_way:
        while more and len(under_way) < at_once:
            if (row := next(source, None)) is None:
                more = False
                break
            under_way[no] = row, time.monotonic() + deadline_s
            threading.Thread(target=work, args=(no, row), daemon=True).start()
            no += 1
        if not under_way:
            break
        wait = min(end for _, end in under_way.values()) - time.monotonic()
        try:
            which, *outcome = ended.get(timeout=max(wait, 0.0))
            if which in under_way:
                yield under_way.pop(which)[0], *outcome
        except queue.Empty:
            now = time.monotonic()
            for late in [n for n, (_, end) in under_way.items() if end <= now]:
                yield under_way.pop(late)[0], None, "timeout", f"no answer within {deadline_s:g} s"


def call_each(df: DataFrame, call: Callable[[dict], dict], result: str, at_once: int = 5, deadline_s: float = 120.0, drop: Collection[str] = ()) -> DataFrame:
    """df with `result` (a struct of the fields that call gives for a row), error_type (null, `timeout` or `exception`) and error_detail; columns named so are replaced. Columns in `drop` are for the call only.

    Every row comes out once, whatever its call does. Calls at once in all are `at_once` times the tasks that run, so repartition df for more or fewer.
    """
    kept = df.select(*[c for c in df.columns if c not in ("result", "error_type", "error_detail")])
    schema = T.StructType([*(f for f in kept.schema if f.name not in drop), T.StructField("result", T._parse_datatype_string(f"struct<{result}>")), T.StructField("error_type", T.StringType()), T.StructField("error_detail", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for row, found, kind, detail in in_flight((r for b in batches for at in range(0, b.num_rows, _AT_A_TIME) for r in b.slice(at, _AT_A_TIME).to_pylist()), call, at_once, deadline_s):
            out.append({k: v for k, v in row.items() if k not in drop} | {"result": found, "error_type": kind, "error_detail": detail})
            if len(out) == _TOGETHER:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return kept.mapInArrow(run, schema)
