"""Extraction cascade over whole tables: each stage works on the sites that the cheaper ones before it left open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.operators import extract as ex
from tidewise.operators.ingest import failure_type
from tidewise.sources.shared import materialise, scratch

ITEMS = ["site", "platform_type", "method", "ord", "name", "description", "price", "category"]
#: A paid reader: pages (site, url, html, platform_type) -> items (site, ord, name, description, price, category).
Provider = Callable[[DataFrame], DataFrame]


def _pdf_items(links: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """Items of the first `most` linked PDFs of each site, merged by name; sites with fewer than three have none."""
    pdfs = links.where(F.lower("link").endswith(".pdf")).groupBy("site", "platform_type").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "link"))), 1, most).alias("l"))
    pdfs = pdfs.select("site", "platform_type", F.explode("l").alias("l")).select("site", "platform_type", "l.*")
    read = pdfs.join(texts.where(F.length("text") >= 50), pdfs["link"] == texts["url"]).select("site", "platform_type", "rank", "link", "text")
    lines = ex.parse_lines(read.select(F.col("link").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    enough = lines.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= ex.LEAST_ITEMS).select("doc_id")
    found = read.drop("text").join(lines.join(enough, "doc_id"), F.col("link") == F.col("doc_id"))
    first = found.groupBy("site", "platform_type", F.lower(F.trim("name")).alias("key")).agg(F.min_by(F.struct("rank", "pos", "name", "description", "price", "category"), F.struct("rank", "pos")).alias("i"))
    counted = first.join(first.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") >= ex.LEAST_ITEMS).select("site"), "site")
    return counted.select("site", "platform_type", F.lit("pdf").alias("method"), (F.col("i.rank") * 100_000 + F.col("i.pos")).alias("ord"), "i.name", "i.description", "i.price", "i.category")


def _page_items(links: DataFrame, pages: DataFrame, patterns: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(items of the first linked page of each site that has any, linked pages as read)."""
    read = links.where(~F.lower("link").endswith(".pdf")).join(pages, F.col("link") == pages["url"]).select("site", "platform_type", "rank", "url", "html")
    found = ex.extract_free(read.select("url", "html", "platform_type").dropDuplicates(["url", "platform_type"]), patterns)
    hits = read.drop("html").join(found, ["url", "platform_type"]).where("method <> 'none'")
    best = hits.groupBy("site").agg(F.min("rank").alias("rank"))
    return hits.join(best, ["site", "rank"]).select(ITEMS), read


def _links(read: DataFrame, **options) -> DataFrame:
    """(site, platform_type, rank, link) of the menu links on pages (site, platform_type, url, html), by page and place."""
    found = ex.page_links(read.select("url", "html").dropDuplicates(["url"]), **options)
    linked = read.select("site", "platform_type", "rank", "url").join(found, "url")
    return linked.groupBy("site", "platform_type", "link").agg(F.min(F.col("rank") * 100 + F.col("place")).alias("rank")).select("site", "platform_type", "rank", "link")


def scrape(sites: DataFrame, pages: DataFrame, texts: DataFrame, patterns: DataFrame | None = None, paid: list[tuple[str, Provider]] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(outcomes, items) of sites (site) whose pages are in pages (url, html, rendered_html, archived_html) and PDF texts in texts (url, text).

    Stages: free methods on the landing page; linked PDFs; linked pages; the PDFs and pages those link to; then the paid
    readers in their order, none by default. outcomes: site, platform_type, method, used_pattern, n_items, failure.
    Every stage's rows are written in the shared folder, so that plans stay short; what only later stages read goes at the end.
    """
    with scratch(sites.sparkSession) as keep:
        pages = pages.select("url", ex.page_html(F.col("html"), F.col("rendered_html"), F.col("archived_html")).alias("html")).where("html is not null")
        landing = sites.join(pages, sites["site"] == pages["url"]).select("site", "url", "html", ex.platform(F.col("html")).alias("platform_type"), F.lit(0).alias("rank"))
        landing = keep(materialise(landing))
        stages, open_sites = [], landing

        def settle(found: DataFrame) -> None:
            nonlocal open_sites
            found = keep(materialise(found.select(ITEMS)))
            stages.append(found)
            open_sites = materialise(open_sites.join(found.select("site").distinct(), "site", "left_anti"))

        settle(ex.extract_free(landing.select("url", "html", "platform_type"), patterns).where("method <> 'none'").withColumnRenamed("url", "site"))
        links = materialise(_links(open_sites, **options))
        alone = open_sites.join(links.select("site").distinct(), "site", "left_anti")
        guessed = alone.select("site", "platform_type", F.posexplode(F.array(*map(F.lit, ex.FALLBACK_PATHS))).alias("rank", "path"))
        links = materialise(links.unionByName(guessed.select("site", "platform_type", "rank", F.concat(F.regexp_replace("site", "/+$", ""), "path").alias("link"))))
        settle(_pdf_items(links, texts))
        found, read = _page_items(links.join(open_sites.select("site"), "site", "left_semi"), pages, patterns)
        read = materialise(read)
        settle(found)
        deeper = _links(read.join(open_sites.select("site"), "site", "left_semi"), **options).join(links.select("site", "link"), ["site", "link"], "left_anti")
        deeper = materialise(deeper.select("site", "platform_type", "rank", "link"))
        settle(_pdf_items(deeper, texts))
        settle(_page_items(deeper.join(open_sites.select("site"), "site", "left_semi"), pages, patterns)[0])
        known = landing.select("site", "url", "html", "platform_type").unionByName(read.select("site", "url", "html", "platform_type"))
        for method, provider in paid or []:
            items = provider(known.join(open_sites.select("site"), "site", "left_semi"))
            settle(items.join(landing.select("site", "platform_type"), "site").withColumn("method", F.lit(method)))
    items = stages[0]
    for more in stages[1:]:
        items = items.unionByName(more)
    got = items.groupBy("site").agg(F.first("method").alias("method"), F.count("*").alias("n_items"))
    outcomes = sites.join(landing.select("site", "platform_type"), "site", "left").join(got, "site", "left")
    nothing = F.when(F.col("platform_type").isNull(), "none").otherwise("none" if paid else "free_exhausted")
    outcomes = outcomes.select("site", F.coalesce("platform_type", F.lit("unknown")).alias("platform_type"), F.coalesce("method", nothing).alias("method"), F.coalesce("n_items", F.lit(0)).alias("n_items"))
    return outcomes.withColumns({"used_pattern": used_pattern(F.col("method")), "failure": F.when(F.col("n_items") == 0, failure_type(F.col("method"), F.col("platform_type")))}), items


def used_pattern(method: Column) -> Column:
    """Whether a free method gave the items."""
    return method.isin("structured_data", "platform", "pattern", "heuristic", "pdf")


def learned(outcomes: DataFrame, selectors: DataFrame, patterns: DataFrame) -> DataFrame:
    """New patterns (platform_type, detection_rule, selectors) from what a model suggested (site, selectors), for platforms that have none."""
    new = outcomes.where("method = 'llm'").join(selectors, "site").join(patterns.select("platform_type"), "platform_type", "left_anti")
    return new.where(F.map_contains_key("selectors", "menu_item")).groupBy("platform_type").agg(F.min_by("selectors", "site").alias("selectors")).select("platform_type", F.concat(F.lit("platform:"), "platform_type").alias("detection_rule"), "selectors")
