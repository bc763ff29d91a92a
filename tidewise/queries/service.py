"""Queries of ingestion, accounts and reports, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.functions import text as tx
from tidewise.functions.synonyms import synonym_pairs, synonym_table
from tidewise.operators import accounts, ingest, reports
from tidewise.queries.search import BRIDGE_SQL
from tidewise.sources import bridge


def now() -> Column:
    return F.lit(bridge.AS_OF).cast("timestamp")


NOW_SQL = f"timestamp '{bridge.AS_OF}'"
METROS_SQL = """metros as (
  select replace(lower(n_name), ' ', '_') as name, row_number() over (order by count(*) desc, replace(lower(n_name), ' ', '_')) as rank,
         floor(min(lat) * 100) / 100 as sw_lat, floor(min(lng) * 100) / 100 as sw_lng, ceil(max(lat) * 100) / 100 as ne_lat, ceil(max(lng) * 100) / 100 as ne_lng
  from (select s_nationkey, 32.8755::double + ((s_suppkey * 37 + 40) % 101 - 50)::double / 50.0::double * 0.2::double as lat, -117.2295::double + ((s_suppkey * 91 + 30) % 97 - 48)::double / 48.0::double * 0.2::double as lng from supplier)
  join nation on n_nationkey = s_nationkey group by n_name)"""
GRID_SQL = METROS_SQL + """, grid as (
  select name as metro, r::int as row, c::int as col, round(sw_lat + r * dy, 4) as lat, round(sw_lng + c * dx, 4) as lng from (
    select *, unnest(range(0, floor((ne_lng - sw_lng) / dx)::bigint + 1)) as c from (
      select *, unnest(range(0, floor((ne_lat - sw_lat) / dy)::bigint + 1)) as r from (
        select *, 5.0::double / 111.0::double as dy, 5.0::double / (111.0::double * cos(radians((sw_lat + ne_lat) / 2))) as dx from metros))))"""
FAILURES_SQL = """failures as (
  select user_id as restaurant_id, ['bot_blocked', 'js_spa_empty', 'timeout', 'extraction_fail'][count(*) % 4 + 1] as error_type, count(*) as attempts, max(ts) as last_attempt_at,
         (max(event_id) % 3 + 2)::int as extractor_version, min(event_id) % 5 = 0 as resolved from events where event_type = 'error' group by user_id)"""
SUBSCRIPTIONS_SQL = """subscriptions as (
  select user_id, case when event_id % 7 = 0 then 'lifetime' else 'trial' end as tier, event_id as external_id, ts as created_at, case when event_id % 7 <> 0 then ts + interval 7 days end as expires_at, event_id % 4 <> 0 as is_active
  from events where event_type = 'signup')"""
FAVOURITES_SQL = """favourites as (
  select event_id as favourite_id, user_id, event_id % 200 + 1 as item_id, case when event_id % 3 = 0 then props end as note, ts as created_at from events where event_type = 'purchase')"""
PREMIUM_SQL = f"is_active and (tier = 'lifetime' or tier = 'trial' and expires_at is not null and expires_at > {NOW_SQL})"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid of 5 km over the metros of the tables."""
    return geo.grid_points(bridge.supplier_metros(spark, sf_dir), 5.0)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("metro", "row", "col", "lat", "lng", "label")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = ingest.searches(_grid(spark, sf_dir), bridge.food_types(spark))
    return work.select("metro", F.col("ordinal").cast("long").alias("ordinal"), "lat", "lng", "food_type")


SEARCHES_SQL = f"""with {GRID_SQL}, types as (select * from (values {', '.join(f"({i}, '{t}')" for i, t in enumerate(bridge.FOOD_TYPES))}) as t(n, food_type))
select metro, ((row_number() over (partition by metro, n order by row, col) - 1) * 12 + n)::bigint as ordinal, lat, lng, food_type from grid cross join types"""


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with a budget of 50, from checkpoints: the first metro goes on, the second one was completed and starts over."""
    work = ingest.searches(_grid(spark, sf_dir), bridge.food_types(spark))
    is_first = F.col("rank") == 1
    saved = bridge.metros_by_rank(bridge.supplier_metros(spark, sf_dir), 1, 2)
    saved = saved.select(F.col("name").alias("metro"), F.when(is_first, 100).otherwise(7).alias("next_ordinal"), F.when(~is_first, bridge.AS_OF).alias("completed_at"))
    return ingest.remaining(work, saved, 50).select("metro", F.col("ordinal").cast("long").alias("ordinal"), F.col("run_no").cast("long").alias("run_no"))


def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search_plan(_grid(spark, sf_dir))


def ranked_metros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.metros_by_rank(bridge.supplier_metros(spark, sf_dir), 2, 20).select("name", F.col("rank").cast("long").alias("rank"))


def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within 3 km of grid points around them, as a join by cells."""
    places = bridge.restaurants(spark, sf_dir).select("restaurant_id", "lat", "lng")
    points = _grid(spark, sf_dir).select("label", "lat", "lng")
    return geo.nearby_pairs(points, places, 3000.0).select("label", F.col("place_restaurant_id").alias("restaurant_id"), F.round("distance_m", 3).alias("distance_m"))


NEARBY_SQL = f"""with {BRIDGE_SQL}, {GRID_SQL}, pairs as (
  select metro || '_' || row || '_' || col as label, restaurant_id, {geo.distance_sql('g.lat', 'g.lng', 'r.lat', 'r.lng')} as distance_m
  from grid g cross join restaurants r)
select label, restaurant_id, round(distance_m, 3) as distance_m from pairs where distance_m <= 3000"""


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(bridge.restaurants(spark, sf_dir), bridge.menu_items(spark, sf_dir))


def failure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_breakdown(bridge.failures(spark, sf_dir))


def retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.retryable(bridge.failures(spark, sf_dir), bridge.restaurants(spark, sf_dir), "timeout").select("restaurant_id", "error_type", "attempts", "name")


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a made-up website and last visit."""
    places = bridge.restaurants(spark, sf_dir).withColumn("website_url", F.when(F.col("restaurant_id") % 9 != 0, F.concat(F.lit("https://place.example/"), F.col("restaurant_id"))))
    places = places.withColumn("scraped_at", F.when(F.col("restaurant_id") % 4 != 0, now() - F.make_dt_interval((F.col("restaurant_id") % 60).cast("int"))))
    return ingest.due(places, bridge.failures(spark, sf_dir), now()).select("restaurant_id", "website_url")


DUE_SQL = f"""with {BRIDGE_SQL}, {FAILURES_SQL}, places as (
  select restaurant_id, case when restaurant_id % 9 <> 0 then 'https://place.example/' || restaurant_id end as website_url, case when restaurant_id % 4 <> 0 then {NOW_SQL} - to_days((restaurant_id % 60)::int) end as scraped_at from restaurants)
select restaurant_id, website_url from places p where website_url is not null and not coalesce(scraped_at > {NOW_SQL} - interval 30 days, false)
  and not exists (select 1 from failures f where f.restaurant_id = p.restaurant_id and not resolved and extractor_version >= 4)"""


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, as the first place found of each id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("place_id", F.concat_ws("-", "user_id", "event_type"))
    return ingest.first_seen(e, "place_id", "event_id").select("place_id", "event_id", "value")


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name"))
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"))
    return ingest.insert_new(s, found, "place_id")


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without a rating get new lists: what costs less than 950, dearer by 1."""
    items = bridge.menu_items(spark, sf_dir).select("restaurant_id", "item_id", "price")
    unrated = bridge.restaurants(spark, sf_dir).where("rating is null").select("restaurant_id")
    new = items.where("price < 950").join(unrated, "restaurant_id", "left_semi").withColumn("price", F.col("price") + 1)
    return ingest.replace_items(items, new).groupBy("restaurant_id").agg(F.count("*").alias("n_items"), F.round(F.sum("price"), 2).alias("total"))


REPLACED_SQL = f"""with {BRIDGE_SQL}, new as (select restaurant_id, item_id, price + 1 as price from items where price < 950 and restaurant_id in (select restaurant_id from restaurants where rating is null)),
merged as (select restaurant_id, item_id, price from items where restaurant_id not in (select restaurant_id from new) union all select * from new)
select restaurant_id, count(*) as n_items, round(sum(price), 2) as total from merged group by restaurant_id"""


def failure_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = bridge.failures(spark, sf_dir).withColumn("error_detail", F.lit("old"))
    new = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'").select(
        F.col("user_id").alias("restaurant_id"), F.lit("timeout").alias("error_type"), F.col("props").alias("error_detail"), F.lit(4).alias("extractor_version"), F.col("ts").alias("last_attempt_at"), F.lit(1).cast("long").alias("attempts"), F.lit(False).alias("resolved"))
    return ingest.upsert_failures(old, new).select("restaurant_id", "error_type", "attempts", "extractor_version", "resolved")


FAILURE_UPSERT_SQL = f"""with {FAILURES_SQL}, fresh as (select user_id as restaurant_id, count(*) as more from events where event_type = 'click' group by user_id)
select restaurant_id, error_type, attempts, extractor_version, resolved from failures where resolved
union all
select restaurant_id, case when more is null then error_type else 'timeout' end as error_type, coalesce(attempts, 0) + coalesce(more, 0) as attempts, case when more is null then extractor_version else 4 end as extractor_version, false as resolved
from (select * from failures where not resolved) full join fresh using (restaurant_id)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("restaurant_id"))
    return ingest.resolve_failures(bridge.failures(spark, sf_dir), ok).select("restaurant_id", "error_type", "resolved")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.groupBy(F.col("p_type").alias("platform_type"), F.col("p_brand").alias("detection_rule")).agg(F.max("p_name").alias("selectors"), F.count("*").alias("success_count"), F.max("p_size").alias("last_used_at"))


def best_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.best_pattern(_patterns(spark, sf_dir))


def pattern_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _patterns(spark, sf_dir)
    learned = old.where("last_used_at < 40").withColumns({"selectors": F.lit("{}"), "success_count": F.lit(1).cast("long"), "last_used_at": F.col("last_used_at") + 1})
    return ingest.upsert_patterns(old, learned)


_PATTERNS_SQL = "patterns as (select p_type as platform_type, p_brand as detection_rule, max(p_name) as selectors, count(*) as success_count, max(p_size) as last_used_at from part group by all)"


def premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.subscriptions(spark, sf_dir).select("external_id", accounts.is_premium(now()).alias("premium"), accounts.days_remaining(now()).alias("days_remaining"))


def latest_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.subscription_status(bridge.subscriptions(spark, sf_dir), now())


def redeemed(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = bridge.subscriptions(spark, sf_dir)
    receipts = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('purchase', 'signup')").select("user_id", F.col("event_id").alias("external_id"))
    return accounts.redeem(subs, receipts, now()).select("user_id", "tier", "external_id", "is_active")


REDEEMED_SQL = f"""with {SUBSCRIPTIONS_SQL}, fresh as (select user_id, event_id as external_id from events where event_type in ('purchase', 'signup') and event_id not in (select external_id from subscriptions))
select user_id, tier, external_id, is_active and user_id not in (select user_id from fresh) as is_active from subscriptions union all select user_id, 'lifetime', external_id, true from fresh"""


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("item_id"), "p_name")
    return accounts.favourite_items(bridge.favourites(spark, sf_dir), part).select("user_id", F.col("place").cast("long").alias("place"), "favourite_id", "item_id", "p_name", "note")


def favourite_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bridge.favourites(spark, sf_dir)
    return accounts.upsert_favourites(f.where("created_at < '2024-01-16'"), f.where("created_at >= '2024-01-16'")).select("user_id", "item_id", "favourite_id", "note")


FAVOURITE_UPSERT_SQL = f"""with {FAVOURITES_SQL}
select user_id, item_id, arg_min(favourite_id, (created_at >= '2024-01-16', created_at, favourite_id)) as favourite_id, arg_max(note, (created_at >= '2024-01-16', created_at, favourite_id)) filter (note is not null) as note from favourites group by user_id, item_id"""


def favourite_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bridge.favourites(spark, sf_dir)
    return accounts.remove_favourites(f, f.where("note is not null").select("favourite_id", (F.col("user_id") + F.col("favourite_id") % 2).alias("user_id"))).select("favourite_id", "user_id")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.menu_sections(bridge.menu_items(spark, sf_dir).withColumn("category", F.when(F.col("item_id") % 5 != 0, F.col("category"))))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = bridge.menu_items(spark, sf_dir).withColumn("price", F.when(F.col("item_id") % 23 == F.col("restaurant_id") % 23, F.col("price")))
    return reports.coverage(items, "restaurant_id")


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of part names that share a name, as groups of two or three words."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    table = names.select(F.col("p_name").alias("group_id"), F.explode(F.split("p_name", " ")).alias("word"))
    return synonym_pairs(table)


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.bounding_box(bridge.restaurants(spark, sf_dir).withColumn("zone", F.col("restaurant_id") % 7), "zone")
    return b.select("zone", *[F.round(c, 6).alias(c) for c in b.columns if c != "zone"])


BOX_SQL = f"""with {BRIDGE_SQL}, b as (select restaurant_id % 7 as zone, min(lat) as min_lat, max(lat) as max_lat, min(lng) as min_lng, max(lng) as max_lng from restaurants group by 1)
select zone, round(min_lat, 6) as min_lat, round(max_lat, 6) as max_lat, round(min_lng, 6) as min_lng, round(max_lng, 6) as max_lng, round((min_lat + max_lat) / 2, 6) as mid_lat, round((min_lng + max_lng) / 2, 6) as mid_lng,
       round(greatest(1.4::double * (max_lat - min_lat), 0.01::double), 6) as span_lat, round(greatest(1.4::double * (max_lng - min_lng), 0.01::double), 6) as span_lng from b"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a card shows of a place."""
    r = bridge.restaurants(spark, sf_dir).withColumns({"level": (F.col("restaurant_id") % 7 - 1).cast("int"), "n": F.col("restaurant_id") % 5, "d": (F.col("restaurant_id") % 40) / 17.0})
    return r.select(
        "restaurant_id",
        tx.match_tier(F.col("n")).alias("match_tier"),
        tx.level_text(F.col("level")).alias("level"),
        tx.distance_text(F.col("d")).alias("distance"),
        tx.price_text(F.col("d") * 4).alias("price"),
        tx.phone_digits(F.concat(F.lit("+1 (555) "), F.col("name"))).alias("phone"),
        F.round(geo.view_radius_m(F.col("lat"), F.col("d"), F.col("d") * 2), 2).alias("radius_m"),
        tx.cache_key(F.concat(F.lit(" Hot Plate"), "restaurant_id"), F.col("d"), -1 - F.col("d"), F.lit(5000)).alias("cache_key"),
        tx.overflow(F.col("n")).alias("overflow"),
    )


VIEWS_SQL = f"""with {BRIDGE_SQL}, r as (select *, (restaurant_id % 7 - 1)::int as level, restaurant_id % 5 as n, (restaurant_id % 40) / 17.0::double as d from restaurants)
select restaurant_id, case when n >= 3 then 'best' when n >= 1 then 'good' else 'hasItem' end as match_tier, case when level > 0 then repeat('$', least(level, 4)) end as level,
       case when d < 0.1 then 'Nearby' else format('{{:.1f}} mi', d) end as distance, format('${{:.2f}}', d * 4) as price, regexp_replace('+1 (555) ' || place, '[^0-9+]', '', 'g') as phone,
       round(least(greatest(d * 111320.0::double, d * 2 * 111320.0::double * cos(radians(lat))) / 2, 50000.0::double), 2) as radius_m, sha256('hot plate' || restaurant_id || ':' || round(d, 3) || ':' || round(-1 - d, 3) || ':5000') as cache_key,
       greatest(0, n - 4) as overflow from r"""


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a map moved by more than 500 m since the view before."""
    r = bridge.restaurants(spark, sf_dir).withColumn("session", F.col("restaurant_id") % 10)
    return r.select("restaurant_id", "session", geo.has_moved(["session"], "restaurant_id").alias("moved"))


MOVED_SQL = f"""with {BRIDGE_SQL}, l as (select *, restaurant_id % 10 as session, lag(lat) over w as a, lag(lng) over w as b from restaurants window w as (partition by restaurant_id % 10 order by restaurant_id))
select restaurant_id, session, coalesce({geo.distance_sql('a', 'b', 'lat', 'lng')} > 500, true) as moved from l"""

_CORE = "case when metro = (select name from metros where rank = 1) then 100 else 0 end"
QUERIES = {
    "ge05_grid": (grid, f"with {GRID_SQL} select *, metro || '_' || row || '_' || col as label from grid"),
    "jn10_searches": (searches, SEARCHES_SQL),
    "sm02_budget": (resumed, f"with {METROS_SQL}, work as ({SEARCHES_SQL}) select metro, ordinal, row_number() over (partition by metro order by ordinal) as run_no from work where ordinal >= {_CORE} qualify run_no <= 50"),
    "ag12_search_plan": (search_plan, f"with {GRID_SQL} select metro, count(*) as points, count(*) * 12 as core_searches, count(*) * 34 as full_searches, count(*) * 12 // 8000 + 1 as months from grid group by metro"),
    "flt14_metros_by_rank": (ranked_metros, f"with {METROS_SQL} select name, rank from metros where rank between 2 and 20"),
    "jn11_nearby": (nearby, NEARBY_SQL),
    "jn09_totals": (totals, f"with {BRIDGE_SQL} select count(distinct r.restaurant_id) as n_restaurants, count(i.item_id) as n_items from restaurants r left join items i on r.restaurant_id = i.restaurant_id"),
    "ag09_failures": (failure_breakdown, f"with {FAILURES_SQL} select error_type, count(*) as n, min(extractor_version) as min_version from failures group by error_type"),
    "jn06_retryable": (retryable, f"with {BRIDGE_SQL}, {FAILURES_SQL} select restaurant_id, error_type, attempts, place as name from failures join restaurants using (restaurant_id) where not resolved and error_type = 'timeout'"),
    "jn08_due": (due, DUE_SQL),
    "ag16_first_seen": (first_seen, "select user_id || '-' || event_type as place_id, min(event_id) as event_id, arg_min(value, event_id) as value from events group by 1"),
    "snk01_insert_new": (insert_new, "select s_suppkey as place_id, s_name as name from supplier union all select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)"),
    "snk02_replace": (replaced, REPLACED_SQL),
    "snk03_failure_upsert": (failure_upsert, FAILURE_UPSERT_SQL),
    "snk04_resolve": (resolved, f"with {FAILURES_SQL} select restaurant_id, error_type, resolved or restaurant_id in (select s_suppkey from supplier where s_acctbal >= 0) as resolved from failures"),
    "wn07_best_pattern": (best_pattern, f"with {_PATTERNS_SQL} select platform_type, arg_max(selectors, (success_count, detection_rule)) as selectors, max(success_count) as success_count from patterns group by platform_type"),
    "snk06_pattern_upsert": (pattern_upsert, f"with {_PATTERNS_SQL} select platform_type, detection_rule, case when last_used_at < 40 then '{{}}' else selectors end as selectors, success_count + (last_used_at < 40)::int as success_count, last_used_at + (last_used_at < 40)::int as last_used_at from patterns"),
    "flt13_premium": (premium, f"with {SUBSCRIPTIONS_SQL} select external_id, {PREMIUM_SQL} as premium, greatest(0, floor((epoch(expires_at) - epoch({NOW_SQL})) / 86400))::bigint as days_remaining from subscriptions where expires_at is not null union all select external_id, {PREMIUM_SQL}, null from subscriptions where expires_at is null"),
    "wn06_latest_subscription": (latest_subscription, f"with {SUBSCRIPTIONS_SQL} select user_id, tier, created_at, {PREMIUM_SQL} as premium, case when expires_at is not null then greatest(0, floor((epoch(expires_at) - epoch({NOW_SQL})) / 86400))::bigint end as days_remaining from subscriptions where is_active qualify row_number() over (partition by user_id order by created_at desc, external_id desc) = 1"),
    "snk09_redeem": (redeemed, REDEEMED_SQL),
    "jn05_favourites": (favourites, f"with {FAVOURITES_SQL}, n as (select *, row_number() over (partition by user_id order by created_at desc, favourite_id) as place from favourites) select user_id, place, favourite_id, item_id, p_name, note from n join part on p_partkey = item_id"),
    "snk08_favourite_upsert": (favourite_upsert, FAVOURITE_UPSERT_SQL),
    "snk08_favourite_removal": (favourite_removal, f"with {FAVOURITES_SQL} select favourite_id, user_id from favourites where not (note is not null and favourite_id % 2 = 0)"),
    "ag18_sections": (sections, f"with {BRIDGE_SQL} select restaurant_id, coalesce(case when item_id % 5 <> 0 then category end, 'Other') as section, count(*) as n_items, min(price) as min_price from items group by all"),
    "ag13_coverage": (coverage, f"with {BRIDGE_SQL}, p as (select restaurant_id, case when item_id % 23 = restaurant_id % 23 then price end as price from items) select restaurant_id, count(*) as n_items, count(price) as n_priced, count(price) / count(*) as share, count(price) / count(*) >= 0.3 or count(price) >= 3 as accepted from p group by restaurant_id"),
    "ag19_synonyms": (synonyms, "with t as (select distinct p_name as g, unnest(string_split(p_name, ' ')) as word from part) select distinct a.word, b.word as synonym from t a join t b using (g) where a.word <> b.word"),
    "ag17_bounding_box": (box, BOX_SQL),
    "cv01_views": (views, VIEWS_SQL),
    "wn08_moved": (moved, MOVED_SQL),
}
