"""Pages read from sites as a Spark data source, in batch or as a stream that asks each site for so many pages a step.

`plan_pages` lays the addresses out once, in folders step=…/part=…: a step has at most `rate` addresses of any site, and a part those of one
bucket of addresses. Both readers take these folders as partitions, so the driver knows numbers of steps and parts, never addresses:

    plan_pages(urls, path, rate=30)
    spark.dataSource.register(PageSource)
    spark.read.format("site_pages").options(plan=path, transport="package.module:factory").load()
    spark.readStream.format("site_pages").options(plan=path, transport=…, interval_s="60", state=folder).load()

The transport is passed in as the name of a factory: factory(options, part) gives a function of (url, timeout_s) that gives a dict of `status`, `final_url` and `html`, redirects
followed. It is called in the tasks, `at_once` (5) calls in each, and given up after `deadline_s` (15). Every address comes out once: url, site, step, status,
final_url, html (null but for statuses below 300), error_type (null, `http_error`, `timeout`, `exception`) and error_detail.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewise.operators.providers import in_flight
from tidewise.sources.shared import materialise

SCHEMA = "url string, site string, step int, status int, final_url string, html string, error_type string, error_detail string"
_ARROW = pa.schema([("url", pa.string()), ("site", pa.string()), ("step", pa.int32()), ("status", pa.int32()), ("final_url", pa.string()), ("html", pa.string()), ("error_type", pa.string()), ("error_detail", pa.string())])
_TOGETHER = 64


def site_of(url: Column) -> Column:
    """The host of an address in lower case, empty where it has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def part_of(url: Column, parts: int) -> Column:
    return F.pmod(F.crc32(url.cast("binary")), F.lit(parts)).cast("int")


def paced(requests: DataFrame, rate: int) -> DataFrame:
    """(url, site, step) of the different addresses of requests (url): the n-th of a site, in their order, has step (n - 1) div rate.

    Addresses are numbered by ranges, so that a site may have any share of them. Rows without an address ask for nothing and don't come out.
    """
    if rate < 1:
        raise ValueError("rate has to be 1 or more")
    ranged = requests.where("url is not null").select("url").distinct().withColumn("site", site_of(F.col("url"))).repartitionByRange("site", "url")
    ranged = materialise(ranged.withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("site").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("site", "range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("site", "range").orderBy("url")) - 1
    numbered = ranged.withColumn("within", within).join(starts.select("site", "range", "start"), ["site", "range"])
    return numbered.select("url", "site", F.floor((F.col("start") + F.col("within")) / rate).cast("int").alias("step"))


def plan_pages(requests: DataFrame, path: str, rate: int = 30, parts: int = 8) -> None:
    """Write the addresses of requests (url) to path, by step and part, for the readers."""
    out = paced(requests, rate).withColumn("part", part_of(F.col("url"), parts))
    out.repartition("step", "part").write.partitionBy("step", "part").parquet(path)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _numbers(path: str, name: str) -> list[int]:
    """The numbers of the folders name=… in a folder, ascending."""
    fs, where = _opened(path)
    found = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))
    return sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith(f"{name}="))


def rows_of(path: str, columns: list[str]) -> Iterator[dict]:
    """The rows of all Parquet files of one folder, a batch at a time."""
    fs, where = _opened(path)
    for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=1024, columns=columns):
                    yield from batch.to_pylist()


class Part(InputPartition):
    """The addresses of one part of one step."""

    def __init__(self, step: int, part: int):
        self.step, self.part = step, part


class _Pages:
    """What both readers share; options are checked before anything runs."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.plan, self.transport = self.options["plan"], self.options["transport"]
        self.at_once, self.deadline_s = int(self.options.get("at_once", 5)), float(self.options.get("deadline_s", 15))

    def parts(self, steps: range | list[int]) -> list[Part]:
        return [Part(s, p) for s in steps for p in _numbers(f"{self.plan}/step={s}", "part")]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Part):  # a plan without addresses
            return
        module, name = self.transport.split(":")
        get: Callable[[str, float], dict] = getattr(importlib.import_module(module), name)(self.options, partition.part)
        rows = rows_of(f"{self.plan}/step={partition.step}/part={partition.part}", ["url", "site"])
        out: list[dict] = []
        for row, found, error, detail in in_flight(rows, lambda r: get(r["url"], self.deadline_s), self.at_once, self.deadline_s):
            found = found or {}
            status = found.get("status")
            if error is None and (status is None or not 200 <= status < 300):
                error, detail = "http_error", f"status {status}"
            page = {"status": status, "final_url": found.get("final_url"), "html": found.get("html") if error is None else None}
            out.append(row | page | {"step": partition.step, "error_type": error, "error_detail": detail})
            if len(out) == _TOGETHER:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)


class PageReader(_Pages, DataSourceReader):
    """All steps at once: the bound in force is `at_once` calls a task."""

    def partitions(self) -> list[InputPartition]:
        return self.parts(_numbers(self.plan, "step"))


class PageStreamReader(_Pages, DataSourceStreamReader):
    """One step a batch, and no step sooner than `interval_s` after the one before.

    An offset is the number of steps that were admitted. A stream's checkpoint says what was read; the file in `state` only says how far admission had
    come, so that a stream which starts again neither repeats a step nor makes up for the time it stood still.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.interval_s, self.state = float(self.options.get("interval_s", 60)), self.options["state"]
        self.steps = max(_numbers(self.plan, "step"), default=-1) + 1
        self.admitted = self._stored()
        self.again, self.last = self.admitted is not None, None

    def initialOffset(self) -> dict:
        return {"steps": 0}

    def latestOffset(self) -> dict:
        now = time.time()
        if self.again:  # what was admitted may not be in the checkpoint yet
            self.again, self.last = False, now
        elif (self.admitted or 0) < self.steps and (self.last is None or now - self.last >= self.interval_s):
            self.admitted, self.last = (self.admitted or 0) + 1, now
            self._store()
        return {"steps": self.admitted or 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.parts(range(start["steps"], end["steps"]))

    def commit(self, end: dict) -> None:
        pass

    def _stored(self) -> int | None:
        fs, where = _opened(f"{self.state}/admitted.json")
        if fs.get_file_info(where).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_file(where) as f:
            return json.loads(f.read())["steps"]

    def _store(self) -> None:
        fs, where = _opened(self.state)
        fs.create_dir(where, recursive=True)
        with fs.open_output_stream(f"{where}/admitted.new") as f:
            f.write(json.dumps({"steps": self.admitted}).encode())
        fs.move(f"{where}/admitted.new", f"{where}/admitted.json")


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(self.options)


def record(exchanges: DataFrame, path: str, parts: int = 8, order: str = "url") -> None:
    """Write exchanges (url, status, final_url, html) for `recorded`; parts as in the plan.

    Of several for one address the one with the least `order` stays. One without a status is none: its address counts as not recorded. Texts are shuffled once, by part.
    """
    dealt = exchanges.where("url is not null").withColumn("part", part_of(F.col("url"), parts)).repartition(parts, "part")
    kept = dealt.groupBy("part", "url").agg(F.min(F.struct(F.col(order).alias("o"), F.col("status").cast("int").alias("status"), "final_url", "html")).alias("x"))
    kept.where("x.status is not null").select("part", "url", "x.status", "x.final_url", "x.html").write.partitionBy("part").parquet(path)


def recorded(options: dict[str, str], part: int) -> Callable[[str, float], dict]:
    """A transport that answers from the folder `recording`; a task holds one part of it. An address that isn't there raises LookupError."""
    known = {r.pop("url"): r for r in rows_of(f"{options['recording']}/part={part}", ["url", "status", "final_url", "html"])}

    def get(url: str, timeout_s: float) -> dict:
        if url not in known:
            raise LookupError("not recorded")
        return known[url]

    return get


def newest_snapshots(snapshots: DataFrame) -> DataFrame:
    """(url, snapshot_url, taken_at) of the newest available snapshot of each address, the largest of equally old ones."""
    newest = F.max_by(F.struct("snapshot_url", "taken_at"), F.struct("taken_at", "snapshot_url")).alias("s")
    usable = snapshots.where("available and url is not null and snapshot_url is not null")
    return usable.groupBy("url").agg(newest).select("url", "s.snapshot_url", "s.taken_at")
