import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewise.sources.fetch import PageSource, newest_snapshots, paced, plan_pages, record, site_of


def slow(options, part):
    """A transport some of whose answers are late or raise."""

    def get(url, timeout_s):
        if url.endswith("/late"):
            time.sleep(30)
        if url.endswith("/broken"):
            raise ConnectionError("reset")
        return {"status": 410 if url.endswith("/gone") else 200, "final_url": url, "html": f"<p>{url}</p>"}

    return get


def addresses(spark, urls):
    return spark.createDataFrame([(u, i, "x") for i, u in enumerate(urls)], "url string, step int, site string")


URLS = [f"http://Big.example/{i:04}" for i in range(700)] + [f"https://s{i}.example:8080/a?b=//c" for i in range(90)] + ["http://big.example/0001#x", "no address", "", None, "http://s1.example:8080", "http://s1.example:8080"]


def test_steps_have_rate_pages_of_a_site(spark):
    rows = paced(addresses(spark, URLS), 30).collect()
    assert sorted(r.url for r in rows) == sorted({u for u in URLS if u is not None})
    by_site = {}
    for r in sorted(rows, key=lambda r: r.url):
        by_site.setdefault(r.site, []).append(r.step)
    assert all(steps == [i // 30 for i in range(len(steps))] for steps in by_site.values()) and len(by_site["big.example"]) == 701
    with pytest.raises(ValueError):
        paced(addresses(spark, URLS), 0)


def test_sites(spark):
    cases = {"http://u:p@A.example:80/x": "a.example", "https://b.example?q=http://c.example": "b.example", "d.example/x": "", "": ""}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", site_of(F.col("u")).alias("s")).collect()
    assert {r.u: r.s for r in got} == cases


def test_failures_are_rows(spark, tmp_path):
    spark.dataSource.register(PageSource)
    urls = [f"http://a.example/{i}" for i in range(40)] + ["http://a.example/late", "http://b.example/broken", "http://b.example/gone"]
    plan_pages(addresses(spark, urls), str(tmp_path / "plan"), 10, 2)
    rows = spark.read.format("site_pages").options(plan=f"file://{tmp_path}/plan", transport="tests.test_fetch:slow", deadline_s="2", at_once="3").load().collect()
    got = {r.url.rsplit("/", 1)[1]: r for r in rows}
    assert len(rows) == len(urls) == len(got)
    assert got["late"].error_type == "timeout" and got["broken"].error_detail == "ConnectionError: reset" and (got["gone"].error_type, got["gone"].status, got["gone"].html) == ("http_error", 410, None)
    assert all(got[str(i)].html == f"<p>http://a.example/{i}</p>" and got[str(i)].error_type is None for i in range(40))


def test_nothing_to_read(spark, tmp_path):
    spark.dataSource.register(PageSource)
    plan_pages(addresses(spark, [None]), str(tmp_path / "plan"))
    assert spark.read.format("site_pages").options(plan=str(tmp_path / "plan"), transport="tests.test_fetch:slow").load().collect() == []


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(PageSource)
    plan_pages(addresses(spark, URLS), str(tmp_path / "plan"), 100, 2)
    record(spark.createDataFrame([(u, 200, u, "x") for u in {u for u in URLS if u is not None}], "url string, status int, final_url string, html string"), str(tmp_path / "recording"), 2)
    steps = 8  # 701 pages of one site

    def start(interval):
        pages = spark.readStream.format("site_pages").options(plan=str(tmp_path / "plan"), recording=str(tmp_path / "recording"), state=str(tmp_path / "state"), transport="tidewise.sources.fetch:recorded", interval_s=interval).load()
        return pages.writeStream.option("checkpointLocation", str(tmp_path / "progress")).format("parquet").start(str(tmp_path / "out"))

    read = lambda: [(r.url, r.step) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    first = start("3600")
    first.processAllAvailable()
    first.stop()
    assert {s for _, s in read()} == {0}  # the next step is not due for an hour
    second = start("0")
    second.processAllAvailable()  # the first look after a start admits nothing new
    second.processAllAvailable()
    second.stop()
    rows = read()
    assert Counter(u for u, _ in rows) == Counter({u for u in URLS if u is not None}) and {s for _, s in rows} == set(range(steps))
    third = start("0")
    third.processAllAvailable()
    third.processAllAvailable()
    third.stop()
    assert len(read()) == len(rows)


def test_recording_keeps_the_first_exchange(spark, tmp_path):
    rows = [("a", 2, 200, "a", "new"), ("a", 1, 404, "a", "old"), ("b", 1, None, "b", "x"), ("b", 2, 200, "b", "y"), (None, 1, 200, None, "z"), ("c", 1, 200, None, None), ("c", 1, 200, None, None)]
    record(spark.createDataFrame(rows, "url string, n int, status int, final_url string, html string"), str(tmp_path / "r"), 3, "n")
    got = {r.url: (r.status, r.html) for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got == {"a": (404, "old"), "c": (200, None)} and spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_newest_snapshot(spark):
    rows = [("a", "s1", "2020", True), ("a", "s2", "2022", False), ("a", "s3", "2021", True), ("b", "s4", "2020", False), (None, "s5", "2020", True), ("c", None, "2020", True), ("d", "s6", "2020", True), ("d", "s7", "2020", True)]
    got = newest_snapshots(spark.createDataFrame(rows, "url string, snapshot_url string, taken_at string, available boolean")).collect()
    assert {r.url: (r.snapshot_url, r.taken_at) for r in got} == {"a": ("s3", "2021"), "d": ("s7", "2020")}
