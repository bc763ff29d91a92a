"""Queries of pages read through the data source, over a recorded transport, with the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.operators import extract as ex
from tidewise.sources import fetch
from tidewise.sources.shared import materialise, remove, scratch, shared_dir

#: Pages of a site that a step asks for.
RATE = 1000
#: Addresses that one task answers from the recording, about.
TOGETHER = 20_000


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sites answer, by page; some are busy, some gone, some redirected and some never answered."""
    status = F.when(F.col("page_id") % 19 == 7, None).when(F.col("page_id") % 10 == 3, 503).when(F.col("page_id") % 17 == 5, 404).otherwise(200)
    final = F.when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("/"))).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", status.alias("status"), final.alias("final_url"), "html")


@contextmanager
def _planned(spark: SparkSession, sf_dir: str) -> Iterator[tuple[dict[str, str], Callable[[DataFrame], DataFrame]]]:
    """(options of the source, keep) over a plan and a recording of all pages, which go at the end."""
    folder = f"{shared_dir(spark)}/tidewise/{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = max(8, pages.count() // TOGETHER)
    spark.dataSource.register(fetch.PageSource)
    try:
        with scratch(spark) as keep:
            fetch.plan_pages(pages, f"{folder}/plan", RATE, parts)
            fetch.record(_exchanges(spark, sf_dir), f"{folder}/recording", parts, "page_id")
            yield {"plan": f"{folder}/plan", "recording": f"{folder}/recording", "transport": "tidewise.sources.fetch:recorded", "state": f"{folder}/state", "folder": folder}, keep
    finally:
        remove(spark, folder)


def _shown(read: DataFrame) -> DataFrame:
    return read.select("url", "site", F.col("step").cast("long").alias("step"), F.col("status").cast("long").alias("status"), "final_url", F.md5("html").alias("html_md5"), "error_type", "error_detail")


def read_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the batch reader."""
    with _planned(spark, sf_dir) as (options, keep):
        return keep(materialise(_shown(spark.read.format("site_pages").options(**options).load())))


def stream_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the stream, a step a batch."""
    with _planned(spark, sf_dir) as (options, keep):
        folder = options["folder"]
        pages = spark.readStream.format("site_pages").options(**options, interval_s="0").load()
        stream = pages.writeStream.option("checkpointLocation", f"{folder}/progress").format("parquet").start(f"{folder}/out")
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        return keep(materialise(_shown(spark.read.schema(pages.schema).parquet(f"{folder}/out"))))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of every address at ten pages of a site a step."""
    return fetch.paced(spark.read.parquet(f"{sf_dir}/pages.parquet"), 10).select("url", "site", F.col("step").cast("long").alias("step"))


def _snapshots(pages: DataFrame) -> DataFrame:
    """Up to three snapshots of every page, some not available."""
    years = pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int"))).alias("k"))
    taken = F.concat((F.lit(2020) + (F.col("page_id") + F.col("k") * 2) % 5).cast("int").cast("string"), F.lit("0101000000"))
    return years.select("url", F.concat(F.lit("https://archive.example/web/"), taken, F.lit("/"), "url").alias("snapshot_url"), taken.alias("taken_at"), ((F.col("page_id") + F.col("k")) % 4 != 0).alias("available"))


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address to read where a page fails: the raw form of its newest available snapshot."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    failed = pages.where("page_id % 3 <> 1").select("page_id", "url")
    read = failed.join(fetch.newest_snapshots(_snapshots(pages)), "url", "left")
    return read.select("page_id", ex.archive_url(F.col("snapshot_url")).alias("raw_url"), "taken_at")


_SITE = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _steps_sql(rate: int) -> str:
    return f"select url, site, (row_number() over (partition by site order by url) - 1) // {rate} as step from (select distinct url, {_SITE} as site from pages where url is not null)"


READ_SQL = f"""
with steps as ({_steps_sql(RATE)}), first as (select url, page_id, html, row_number() over (partition by url order by page_id, html nulls first) as n from pages where url is not null),
answers as (select url, page_id % 19 <> 7 as known, html, case when page_id % 10 = 3 then 503 when page_id % 17 = 5 then 404 else 200 end::bigint as code, case when page_id % 4 = 1 then url || '/' else url end as final_url from first where n = 1)
select url, site, step, case when known then code end as status, case when known then a.final_url end as final_url, case when known and code = 200 then md5(html) end as html_md5,
       case when not known then 'exception' when code <> 200 then 'http_error' end as error_type, case when not known then 'LookupError: not recorded' when code <> 200 then 'status ' || code end as error_detail
from steps join answers a using (url)"""

ARCHIVED_SQL = """
with snapshots as (select url, (2020 + (page_id + k * 2) % 5)::varchar || '0101000000' as taken_at, (page_id + k) % 4 <> 0 as available from (select page_id, url, unnest(range(0, page_id % 3 + 1)) as k from pages)),
newest as (select url, max(taken_at) as taken_at from snapshots where available group by url)
select page_id, 'https://archive.example/web/' || taken_at || 'id_/' || url as raw_url, taken_at from pages left join newest using (url) where page_id % 3 <> 1"""

QUERIES = {
    "src05_read_sites": (read_sites, READ_SQL),
    "sm12_stream_sites": (stream_sites, READ_SQL),
    "sm12_steps": (steps, _steps_sql(10)),
    "src09_snapshots": (archived, ARCHIVED_SQL),
}
