import time

from pyspark.sql import functions as F

from tidewise.operators.models import first_pages, learn_selectors, read_images, read_texts


def answer(row):
    if row["url"] == "late":
        time.sleep(30)
    return {"answer": {"list": '[{"name": "Soup", "price": "4.5", "x": 1}, {"name": null, "price": 2}]', "empty": "[]", "none": None, "prose": "Sorry", "object": '{"name": "Soup"}'}.get(row["url"], str(len(row["text"])))}


def test_texts_are_cut_and_failures_are_rows(spark):
    rows = [(u, "é" * 200, 1) for u in ("list", "empty", "none", "prose", "late")] + [("short", "x" * 199, 1), ("null", None, 1), ("list", "y" * 40_000, 2)]
    items, failures = read_texts(spark.createDataFrame(rows, "url string, text string, answer int"), answer, deadline_s=3.0)
    assert sorted((r.url, r.name, r.price) for r in items.collect()) == [("list", "Soup", 4.5)] * 2
    assert sorted((r.url, r.error_type) for r in failures.collect()) == [("late", "timeout"), ("none", "bad_answer"), ("prose", "bad_answer")]
    long = spark.createDataFrame([("https://x", "y" * 40_000)], "url string, text string")
    assert read_texts(long, lambda r: {"answer": f'[{{"name": "{len(r["text"])}"}}]'})[0].collect()[0].name == "15000"
    assert read_texts(long.limit(0), answer)[0].collect() == []


def test_selectors_need_a_container(spark):
    said = {"a": '```json\n{"menu_item": ".dish", "item_name": "b"}\n```', "b": '{"item_name": "b"}', "c": "none", "d": '{"menu_item": ""}'}
    pages = spark.createDataFrame([(u, "<p>" + "x" * 5000) for u in said] + [("e", None)], "url string, html string")
    found, failures = learn_selectors(pages, lambda r: {"answer": said[r["url"]] if len(r["html"]) == 3000 else None})
    assert [(r.url, r.selectors) for r in found.collect()] == [("a", {"menu_item": ".dish", "item_name": "b"})]
    assert sorted((r.url, r.error_type) for r in failures.collect()) == [(u, "bad_answer") for u in "bcd"]


def test_images(spark):
    rows = [("s", 1, "image/png", b"12"), ("s", 2, None, b"3"), ("s", 3, "image/webp", None), ("t", 1, "x", b"ab")]
    images = spark.createDataFrame(rows, "site string, image_no int, content_type string, data binary").withColumns({"url": F.lit("u"), "name": F.lit("n"), "_n": F.lit(1)})

    def see(row):
        if row["site"] == "t":
            return {"answer": "[1, 2"}
        return {"answer": str([{"name": f"{row['media_type']} {k}", "price": len(row["data"])} for k in range(3)]).replace("'", '"')}

    items, failures = read_images(images, see)
    assert sorted((r.site, r.image_no, r.name, r.price) for r in items.collect()) == [("s", 1, f"image/png {k}", 2.0) for k in range(3)] + [("s", 2, f"image/jpeg {k}", 1.0) for k in range(3)]
    assert [(r.site, r.image_no) for r in failures.collect()] == [("t", 1)]


def test_first_pages(spark):
    pages = spark.createDataFrame([("a", n) for n in range(9)] + [("b", 3), (None, 1)], "url string, page_no int")
    assert sorted((r.url or "", r.page_no) for r in first_pages(pages).collect()) == [("", 1), *(("a", n) for n in range(5)), ("b", 3)]
