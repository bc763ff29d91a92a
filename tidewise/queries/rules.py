"""Queries of single rules and readers: microdata, learned selectors, tables, model answers, caches, grants, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.functions import text as tx
from tidewise.operators import accounts, ingest, reports
from tidewise.operators import extract as ex
from tidewise.operators import search as s
from tidewise.plans import cascade
from tidewise.queries import more
from tidewise.queries import pages as pq
from tidewise.queries import search as sq
from tidewise.queries import service as vq
from tidewise.sources import bridge


def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    prop = lambda name, value: F.concat(F.lit(f'<i itemprop="{name}">'), value, F.lit("</i>"))
    item = F.concat(F.lit('<div itemscope itemtype="https://schema.org/MenuItem">'), prop("name", F.col("name")), prop("description", F.col("description")), prop("price", F.format_string("$%.2f", F.col("shown"))), F.lit("</div>"))
    return more._extracted(more._built(spark, sf_dir, item))


def _numbered_sql(method: str) -> str:
    return f"""with {more._BUILT_SQL} select restaurant_id, '{method}' as method, row_number() over (partition by restaurant_id order by item_id) - 1 as ord, name, description, shown as price, null::varchar as category
from shown qualify count(*) over (partition by restaurant_id) >= 3"""


def learned_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit('<section class="dish"><b>'), "name", F.lit("</b><em>"), "description", F.lit("</em><u>"), F.format_string("%.2f", F.col("shown")), F.lit("</u></section>"))
    pages = more._built(spark, sf_dir, item).withColumn("platform_type", F.lit("custom"))
    patterns = spark.createDataFrame([("custom", {"item_container": ".dish", "item_name": "b", "item_price": "u", "item_description": "em"})], "platform_type string, selectors map<string,string>")
    found = ex.extract_free(pages, patterns)
    return found.select(F.col("url").cast("long").alias("restaurant_id"), "method", F.col("ord").cast("long").alias("ord"), "name", "description", "price", "category")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with two prices, which only the reader of tables takes: the last one counts."""
    item = F.concat(F.lit("<tr><td>"), "name", F.lit("</td><td>$"), F.format_string("%.2f", F.col("shown") + 1), F.lit("</td><td>$"), F.format_string("%.2f", F.col("shown") + 2), F.lit("</td></tr>"))
    return more._extracted(more._built(spark, sf_dir, item, "<table>", "</table>"))


TABLES_SQL = f"""with {more._BUILT_SQL}, usable as (select *, row_number() over (partition by restaurant_id, lower(name) order by item_id) as n from shown where not regexp_matches(name, '(?i)(merch|tax|tip|total)')),
f as (select *, row_number() over (partition by restaurant_id order by item_id) - 1 as ord, count(*) over (partition by restaurant_id) as total from usable where n = 1)
select restaurant_id, 'heuristic' as method, ord, name, null::varchar as description, shown + 2 as price, null::varchar as category from f where total >= 3"""


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's fenced answer per brand: some names are empty, some prices no numbers."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.when(F.col("p_size") > 40, F.lit("market")).otherwise(F.concat("p_size", F.lit(".25")))
    row = F.to_json(F.struct(F.when(F.col("p_size") == 7, "").otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("description"), price.alias("price"), F.lit("entree").alias("category")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("x")))), lambda x: x["x"]), ",")
    answers = p.groupBy(F.col("p_brand").alias("url")).agg(F.concat(F.lit("```json\n["), listed, F.lit("]\n```")).alias("answer"))
    return ex.model_items(answers).withColumn("ord", F.col("ord").cast("long"))


MODEL_ROWS_SQL = """select * from (select p_brand as url, row_number() over (partition by p_brand order by p_partkey) - 1 as ord, case when p_size = 7 then '' else p_name end as name, p_type as description,
case when p_size <= 40 then p_size + 0.25::double end as price, 'entree' as category from part) where name <> ''"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three different headings of a page per brand, as addresses below it."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    head = F.concat(F.lit("<h3>"), F.when(F.col("p_size") > 40, "Hours").otherwise(F.initcap("p_name")), F.lit("</h3><p>text</p>"))
    pages = p.groupBy(F.concat(F.lit("https://"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), F.lit(".example/")).alias("url")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", head.alias("x")))), lambda x: x["x"]), "").alias("html"))
    return ex.page_locations(pages)


LOCATIONS_SQL = """with h as (select 'https://' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '.example' as base, replace(p_name, ' ', '-') as part, min(p_partkey) as first from part where p_size <= 40 group by all)
select base || '/' as url, base || '/' || part as location_url from h qualify row_number() over (partition by base order by first) <= 3"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("p_size") < 5, F.lit("Find a Location")).when(F.col("p_size") < 10, F.lit("é!")).otherwise(F.concat_ws(" & ", "p_name", "p_type"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.slug(heading).alias("slug"))


SLUGS_SQL = """select p_partkey, case when p_size >= 10 and length(h) between 3 and 50 then trim(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '-') end as slug from (select *, p_name || ' & ' || p_type as h from part)"""


_SECTIONS = ["Sandwiches & Sides", "Small Plate", "Wine List", "Brunch", "Soup of the day", "Tacos", "Sweet", "Others"]


def section_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("p_size") % len(_SECTIONS) + 1).cast("int")), "p_name")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.category(heading).alias("category"))


SECTION_CATEGORIES_SQL = f"select p_partkey, {pq._category_sql('h', tx.SECTION_CATEGORIES, 'null')} as category from (select p_partkey, ({_SECTIONS!r})[p_size % {len(_SECTIONS)} + 1] || ' ' || p_name as h from part)"


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results stored for each place, some of which have run out; every customer asks at one of the places."""
    at = lambda key: {"lat": F.col(key) / 7.0, "lng": F.col(key) / 3.0, "radius": F.lit(5000)}
    stored = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumns(at("s_suppkey"))
    stored = stored.select(tx.cache_key(F.lit("Hot Plate "), F.col("lat"), F.col("lng"), F.col("radius")).alias("key"), F.col("s_name").alias("results"), (vq.now() + F.make_dt_interval(hours=F.col("s_nationkey").cast("int") - 12)).alias("expires_at"))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumns(at("c_custkey")).withColumn("query", F.lit(" hot plate"))
    return s.cached_results(stored, asked, vq.now()).select("c_custkey", "results")


CACHE_SQL = "select c_custkey, s_name as results from customer left join (select * from supplier where s_nationkey > 12) on s_suppkey = c_custkey"


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "c_name", F.element_at(F.array(*map(F.lit, ["@Mail.Example ", "@mail", " @mail.example", "@@mail.example", ""])), (F.col("c_custkey") % 5 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.trim(F.lower(text)).alias("email"), tx.is_email(text).alias("valid"))


EMAILS_SQL = "select c_custkey, trim(lower(' ' || c_name || (['@Mail.Example ', '@mail', ' @mail.example', '@@mail.example', ''])[c_custkey % 5 + 1]), ' ') as email, c_custkey % 5 = 0 as valid from customer"


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bridge.restaurants(spark, sf_dir)
    metres = geo.distance_m(F.col("lat"), F.col("lng"), F.lit(bridge.POINT[0]), F.lit(bridge.POINT[1]))
    return r.select("restaurant_id", F.round(metres, 3).alias("distance_m"), geo.miles(metres).alias("miles"), geo.within_radius(F.col("lat"), F.col("lng"), bridge.POINT, sq.RADIUS).alias("near"))


DISTANCES_SQL = f"with {sq.BRIDGE_SQL} select restaurant_id, round(distance_m, 3) as distance_m, case when distance_m <> 0 then round(distance_m / 1609.34::double, 1) end as miles, distance_m <= 16000 as near from near"


def last_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", (F.col("value") / 10).alias("lat"), (-F.col("value")).alias("lng"))
    return accounts.last_locations(fixes)


def granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a user; the addresses of all suppliers' numbers are granted a subscription for life."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("email"))
    chosen = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit(" "), F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER"))).alias("email"))
    return accounts.grant_lifetime(users, bridge.subscriptions(spark, sf_dir), chosen, vq.now()).select("user_id", "tier", "external_id", "is_active")


GRANTED_SQL = f"""with {vq.SUBSCRIPTIONS_SQL}, chosen as (select c_custkey as user_id from customer join supplier on c_custkey = s_suppkey)
select user_id, tier, external_id, is_active and user_id not in (select user_id from chosen) as is_active from subscriptions union all select user_id, 'lifetime', null, true from chosen"""

_METHODS = ["structured_data", "platform", "heuristic", "llm", "none", "free_exhausted"]
_PLATFORMS = ["custom", "unknown", "toast"]


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome per order: its method by priority and clerk, items by lines."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", pick(_METHODS, F.col("o_orderkey") + F.col("o_custkey")).alias("method"), pick(_PLATFORMS, F.col("o_custkey")).alias("platform_type"))
    lost = F.col("method").isin("none", "free_exhausted")
    return o.withColumn("n_items", F.when(lost, 0).otherwise(F.col("o_orderkey") % 9).cast("long"))


_OUTCOMES_SQL = f"outcomes as (select *, case when method in ('none', 'free_exhausted') then 0 else o_orderkey % 9 end as n_items from (select o_orderkey, ({_METHODS!r})[(o_orderkey + o_custkey) % 6 + 1] as method, ({_PLATFORMS!r})[o_custkey % 3 + 1] as platform_type from orders))"


def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.method_counts(_outcomes(spark, sf_dir))


def failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir)
    failure = F.when(F.col("n_items") == 0, ingest.failure_type(F.col("method"), F.col("platform_type")))
    return o.select("o_orderkey", failure.alias("failure"), cascade.used_pattern(F.col("method")).alias("used_pattern"))


def learned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors that a model suggested for sites of each part type, for types without a known pattern."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    outcomes = p.select(F.col("p_partkey").alias("site"), F.col("p_type").alias("platform_type"), F.when(F.col("p_size") > 10, "llm").otherwise("heuristic").alias("method"))
    selectors = p.select(F.col("p_partkey").alias("site"), F.create_map(F.when(F.col("p_size") > 20, "menu_item").otherwise("item_name"), F.col("p_name")).alias("selectors"))
    known = p.where("p_type like 'PROMO%'").select(F.col("p_type").alias("platform_type")).distinct()
    found = cascade.learned(outcomes, selectors, known)
    return found.select("platform_type", "detection_rule", F.element_at("selectors", "menu_item").alias("menu_item"))


LEARNED_PATTERNS_SQL = """select p_type as platform_type, 'platform:' || p_type as detection_rule, arg_min(p_name, p_partkey) as menu_item from part
where p_size > 20 and p_type not like 'PROMO%' group by p_type"""

QUERIES = {
    "ex02_microdata": (microdata, _numbered_sql("structured_data")),
    "ex07_learned_selectors": (learned_selectors, _numbered_sql("pattern")),
    "ex09_tables": (tables, TABLES_SQL),
    "ex19_model_rows": (model_rows, MODEL_ROWS_SQL),
    "ex15_built_locations": (locations, LOCATIONS_SQL),
    "ex23_learned_patterns": (learned_patterns, LEARNED_PATTERNS_SQL),
    "ex24_failure_types": (failure_types, f"with {_OUTCOMES_SQL} select o_orderkey, case when n_items > 0 then null when method = 'free_exhausted' then 'free_only_skip' when platform_type = 'unknown' then 'bot_blocked' when platform_type = 'custom' and method = 'none' then 'js_spa_empty' else 'extraction_fail' end as failure, method in ('structured_data', 'platform', 'heuristic') as used_pattern from outcomes"),
    "tx11_slugs": (slugs, SLUGS_SQL),
    "tx13_section_categories": (section_categories, SECTION_CATEGORIES_SQL),
    "flt10_cache": (cache, CACHE_SQL),
    "flt22_emails": (emails, EMAILS_SQL),
    "ge02_distances": (distances, DISTANCES_SQL),
    "cv04_last_locations": (last_locations, "select user_id, max(ts) as ts, arg_max(value, ts) / 10 as lat, -arg_max(value, ts) as lng from events group by user_id"),
    "jn13_granted": (granted, GRANTED_SQL),
    "ag11_method_counts": (method_counts, f"with {_OUTCOMES_SQL} select method, count(*) as n_sites, sum(n_items)::bigint as n_items, count(*) filter (n_items = 0) as n_empty from outcomes group by method"),
}
