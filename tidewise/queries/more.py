"""Further queries: ranking inside places, checkpoints, extraction from built pages, and streams."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.operators import accounts, commits, ingest, providers, reports, results
from tidewise.operators import extract as ex
from tidewise.operators import search as s
from tidewise.queries import search as sq
from tidewise.queries import service as vq
from tidewise.sources import bridge
from tidewise.sources.shared import materialise, remove, shared_dir
from tidewise.streaming import jobs, state


def item_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, index = ["hot", "plate"], sq.stored(spark, sf_dir)
    hits = index.candidates("hot plate", bridge.POINT, sq.RADIUS)
    scored = s.item_scores(hits, words, *s.rarity(index.statistics(words, bridge.POINT).first().asDict(), words))
    kept = s.rank_items(scored)
    return kept.select("restaurant_id", "item_id", F.col("item_no").cast("long").alias("item_no"), "n_kept", F.col("eff").cast("long").alias("eff"), F.round("rel", 5).alias("rel"))


ITEM_RANK_SQL = (
    sq.FLAGSHIP_SQL.split("), grouped as (")[0]
    + "), kept as (select *, count(*) over (partition by restaurant_id) as n_kept from numbered where eff = best and best >= 1) select restaurant_id, item_id, item_no, n_kept, eff::bigint as eff, round(rel, 5) as rel from kept where item_no <= 5"
)


def no_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without usable words: places by number of hits, then distance; nothing is trimmed."""
    found = sq.stored(spark, sf_dir).search("pl", bridge.POINT, sq.RADIUS, limit=50)
    return found.select(F.col("position").cast("long").alias("position"), "restaurant_id", "n_hits", "total_matched_items", F.size("matched_items").cast("long").alias("n_listed"))


NO_WORDS_SQL = f"""
with {sq.BRIDGE_SQL}, {sq._hits_sql('pl', [], 'zzzzzz')}, g as (select restaurant_id, count(*) as n, any_value(distance_miles) as distance_miles, min(ord) as ord from hits group by restaurant_id)
select row_number() over (order by -n, {sq._FAR}, ord) as position, restaurant_id, n as n_hits, 0::bigint as total_matched_items, n as n_listed from g qualify position <= 50"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each metro stands after a run of 300 searches from the start."""
    work = ingest.searches(vq._grid(spark, sf_dir), bridge.food_types(spark))
    none = spark.createDataFrame([], "metro string, next_ordinal int, completed_at timestamp")
    saved = ingest.save_checkpoints(ingest.remaining(work, none, 300), work, vq.now())
    return saved.select("metro", F.col("next_ordinal").cast("long").alias("next_ordinal"), "searches", F.col("completed_at").isNotNull().alias("completed"))


CHECKPOINTS_SQL = f"""with {vq.GRID_SQL}, w as (select metro, count(*) * 12 as n from grid group by metro)
select metro, least(n, 300) as next_ordinal, least(n, 300) as searches, n <= 300 as completed from w"""


def sign_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are the users, all customers apply; every fifth address is no address, and some are a user's."""
    users = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("user_id"), F.concat(F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")), F.lit("@mail.example")).alias("email"))
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + 1_000_000).alias("user_id"), F.concat(F.lit(" "), "c_name", F.when(F.col("c_custkey") % 5 != 0, "@MAIL.example ").otherwise("mail")).alias("email"))
    return accounts.sign_up(users, bridge.subscriptions(spark, sf_dir), new, vq.now())[0]


SIGN_UP_SQL = """with users as (select s_suppkey as user_id, replace(lower(s_name), 'supplier', 'customer') || '@mail.example' as email from supplier),
applicants as (select c_custkey + 1000000 as user_id, lower(c_name) || case when c_custkey % 5 <> 0 then '@mail.example' else 'mail' end as email from customer)
select * from users union all select * from applicants where email like '%@%' and email not in (select email from users)"""


def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of unrated places are unknown to the gazetteer."""
    r = bridge.restaurants(spark, sf_dir)
    gazetteer = r.select(F.col("name").alias("address"), F.explode(F.array(F.lit(2), F.lit(1))).alias("ord"), "lat", "lng").withColumn("formatted", F.concat_ws(" #", "address", "ord"))
    return bridge.geocode(r.select(F.when(F.col("rating").isNotNull(), F.col("name")).otherwise(F.concat(F.lit("Old "), "name")).alias("address")), gazetteer).select("address", F.round("lat", 6).alias("lat"), "formatted")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    done = e.groupBy("user_id").agg(F.count("*").alias("searches"), (F.count("*") * 7 + F.col("user_id")).alias("seconds"))
    return reports.progress(done, 1000)


def json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = bridge.menu_items(spark, sf_dir)
    return items.select("restaurant_id", "item_id", s.as_json(items, ["item_id", "name", "category"]).alias("json"))


def failure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of attempts: errors count up, purchases clear; the last state of each user."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("event_type in ('error', 'purchase')")
    attempts = events.select(F.col("user_id").alias("restaurant_id"), "ts", F.when(F.col("event_type") == "error", F.lit("timeout")).alias("error_type"))
    place = f"{shared_dir(spark)}/tidewise/stream-{uuid.uuid4().hex}"
    batches = []
    merge = jobs.versioned_merge(spark, f"{place}/table", "restaurant_id", ingest.merge_attempts)

    def batch(rows: DataFrame, number: int) -> None:
        merge(rows, number)
        batches.append(number)

    attempts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = materialise(jobs.merged_table(spark, f"{place}/table", max(batches) + 1).select("restaurant_id", "attempts", "error_type", "open"))
    remove(spark, place)
    return last


FAILURE_STATE_SQL = """with a as (select user_id, ts, event_type, max(case when event_type = 'purchase' then ts end) over (partition by user_id) as last_ok from events where event_type in ('error', 'purchase')),
n as (select user_id, count(*) filter (event_type = 'error' and (last_ok is null or ts > last_ok)) as attempts from a group by user_id)
select user_id as restaurant_id, attempts, case when attempts > 0 then 'timeout' end as error_type, attempts > 0 as open from n"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stateful_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stateful processor, a key at a time."""
    events = _events(spark, sf_dir).where("event_type in ('error', 'purchase')")
    attempts = events.select(F.col("user_id").alias("restaurant_id"), "ts", F.when(F.col("event_type") == "error", F.lit("timeout")).alias("error_type"), F.lit(4).alias("extractor_version"))
    place = f"{shared_dir(spark)}/tidewise/stream-{uuid.uuid4().hex}"
    state.run_through(state.failure_states(attempts), f"{place}/table", f"{place}/checkpoint")
    rows = spark.read.parquet(f"{place}/table").groupBy("restaurant_id").agg(F.max_by(F.struct("attempts", "error_type", "open"), "batch").alias("x"))
    last = materialise(rows.select("restaurant_id", "x.*"))
    remove(spark, place)
    return last


def seen_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user, by a stream that remembers whom it has seen."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"))
    place = f"{shared_dir(spark)}/tidewise/stream-{uuid.uuid4().hex}"
    state.run_through(state.first_seen(rows), f"{place}/table", f"{place}/checkpoint")
    first = materialise(spark.read.parquet(f"{place}/table").select(F.col("key").alias("user_id"), F.col("ord").alias("first_event")))
    remove(spark, place)
    return first


def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures after a retry of those by timeout: every third place fails again, the others give their items."""
    place = f"{shared_dir(spark)}/tidewise/snapshot-{uuid.uuid4().hex}"
    snapshot = commits.Snapshot(spark, place)
    items = bridge.menu_items(spark, sf_dir).select("restaurant_id", "name")
    failures = bridge.failures(spark, sf_dir).withColumn("error_detail", F.lit(None).cast("string"))
    places = failures.select("restaurant_id").distinct().withColumn("scraped_at", F.lit(None).cast("timestamp"))
    snapshot.commit(0, places=places, items=items.limit(0), failures=failures)
    menus = items.groupBy("restaurant_id").agg(F.collect_list(F.struct("name")).alias("items"))

    def read(due: DataFrame) -> DataFrame:
        return due.select("restaurant_id").join(menus, "restaurant_id", "left").select("restaurant_id", F.when(F.col("restaurant_id") % 3 == 0, "exception").alias("error_type"), F.coalesce("items", F.array().cast("array<struct<name:string>>")).alias("items"))

    commits.retry(snapshot, read, vq.now(), "timeout")
    counts = snapshot.read("items").groupBy("restaurant_id").agg(F.count("*").alias("n_items"))
    after = snapshot.read("failures").join(counts, "restaurant_id", "left")
    last = materialise(after.select("restaurant_id", "error_type", "attempts", "resolved", F.coalesce("n_items", F.lit(0)).alias("n_items")))
    remove(spark, place)
    return last


RETRIED_SQL = f"""with {sq.BRIDGE_SQL}, f as (
  select user_id as restaurant_id, (['bot_blocked', 'js_spa_empty', 'timeout', 'extraction_fail'])[count(*) % 4 + 1] as error_type, count(*) as attempts, min(event_id) % 5 = 0 as resolved from events where event_type = 'error' group by user_id
), n as (select restaurant_id, count(*) as n from items group by restaurant_id), tried as (select *, error_type = 'timeout' and not resolved as due from f)
select restaurant_id, case when due and restaurant_id % 3 = 0 then 'exception' else error_type end as error_type, attempts + (due and restaurant_id % 3 = 0)::int as attempts, resolved or (due and restaurant_id % 3 <> 0) as resolved,
  case when due and restaurant_id % 3 <> 0 then coalesce(n, 0) else 0 end as n_items from tried left join n using (restaurant_id)"""


def _answer(row: dict) -> dict:
    """A service that hangs on every hundredth place and refuses every seventh."""
    if row["restaurant_id"] % 100 == 0:
        time.sleep(60)
    if row["restaurant_id"] % 7 == 0:
        raise ValueError("refused")
    return {"answer": f"menu of {row['name']}"}


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of such a service, five calls at once, a deadline for each."""
    places = bridge.restaurants(spark, sf_dir).select("restaurant_id", "name").repartition(8, "restaurant_id")
    return providers.call_each(places, _answer, "answer string", at_once=5, deadline_s=4.0).select("restaurant_id", F.col("result.answer").alias("answer"), "error_type")


def results_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of all users in two orders, where results of every second event are stored for 20 days in one of them."""
    place = f"{shared_dir(spark)}/tidewise/results-{uuid.uuid4().hex}"
    store = results.ResultStore(spark, place)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lat = 32.0 + (F.col("user_id") % 40) / 100.0
    key = lambda sort: results.result_key(F.col("event_type"), lat, F.lit(-117.0), F.lit(5000.0), sort, F.lit(20))
    store.put(e.where("event_id % 2 = 0").select(key(F.lit("distance")).alias("key"), F.to_json(F.struct("event_id")).alias("results"), F.col("ts").alias("stored_at")), "INTERVAL 20 DAYS")
    asked = e.select("event_type", "user_id").distinct().withColumn("sort", F.explode(F.array(F.lit("distance"), F.lit("rating")))).withColumn("key", key(F.col("sort")))
    found = store.get(asked, dt.datetime.fromisoformat(bridge.AS_OF))
    last = materialise(results.decoded(found, "event_id long").select("event_type", "user_id", "sort", "state", F.col("results.event_id").alias("event_id")))
    remove(spark, place)
    return last


RESULTS_SQL = f"""with stored as (
  select event_type, user_id % 40 as place, max(ts) as newest, arg_max(event_id, (ts, '{{"event_id":' || event_id || '}}')) as event_id from events where event_id % 2 = 0 group by all
), asked as (select distinct event_type, user_id, unnest(['distance', 'rating']) as sort from events)
select asked.event_type, user_id, sort, case when newest + interval 20 days > timestamp '{bridge.AS_OF}' then 'hit' when newest is not null then 'expired' else 'miss' end as state,
  case when newest + interval 20 days > timestamp '{bridge.AS_OF}' then event_id end as event_id
from asked left join stored on sort = 'distance' and asked.event_type = stored.event_type and asked.user_id % 40 = stored.place"""


def _built(spark: SparkSession, sf_dir: str, item: Column, head: str = "", tail: str = "", between: str = "") -> DataFrame:
    """A page per place from its items in order; price is (item_id % 60) + 0.5."""
    i = bridge.menu_items(spark, sf_dir).withColumn("shown", (F.col("item_id") % 60).cast("double") + 0.5)
    rows = i.groupBy("restaurant_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("item_id", item.alias("x"))))["x"], between).alias("body"))
    return rows.select(F.col("restaurant_id").cast("string").alias("url"), F.concat(F.lit(head), "body", F.lit(tail)).alias("html"))


def _extracted(pages: DataFrame, platform: str = "custom") -> DataFrame:
    found = ex.extract_free(pages.withColumn("platform_type", F.lit(platform)))
    return found.where("method <> 'none'").select(F.col("url").cast("long").alias("restaurant_id"), "method", F.col("ord").cast("long").alias("ord"), "name", "description", "price", "category")


def jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit('{"@type":"MenuItem","name":"'), "name", F.lit('","description":" '), "description", F.lit('","offers":[{"price":"$'), F.format_string("%.2f", F.col("shown")), F.lit('"}]}'))
    return _extracted(_built(spark, sf_dir, item, '<html><script type="application/ld+json">{"@graph":[{"@type":"Menu","name":"Hot Drinks","hasMenuItem":[', "]}]}</script></html>", ","))


_BUILT_SQL = f"{sq.BRIDGE_SQL}, shown as (select *, (item_id % 60)::double + 0.5 as shown from items)"
JSONLD_SQL = f"""with {_BUILT_SQL} select restaurant_id, 'structured_data' as method, row_number() over (partition by restaurant_id order by item_id) - 1 as ord, name, description, shown as price, 'drink' as category
from shown qualify count(*) over (partition by restaurant_id) >= 3"""


def platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("<div class='menuItemContainer'><b class='itemHeader'>"), "name", F.lit("</b><i class='price'>$"), F.format_string("%.2f", F.col("shown")), F.lit("</i><p class='itemDescription'>"), "description", F.lit("</p></div>"))
    return _extracted(_built(spark, sf_dir, item), "toast")


PLATFORM_SQL = f"""with {_BUILT_SQL} select restaurant_id, 'platform' as method, row_number() over (partition by restaurant_id order by item_id) - 1 as ord, name, description, shown as price, null::varchar as category
from shown qualify count(*) over (partition by restaurant_id) >= 3"""


def heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("<li>"), "name", F.lit(" ..... $"), F.format_string("%.2f", F.col("shown")), F.lit("</li>"))
    return _extracted(_built(spark, sf_dir, item, "<nav>Menu $1.00</nav><ul>", "</ul>"))


HEURISTIC_SQL = f"""with {_BUILT_SQL}, usable as (select *, row_number() over (partition by restaurant_id, lower(name) order by item_id) as n from shown where shown >= 1 and not regexp_matches(name, '(?i)(merch|tax|tip|total)')),
f as (select *, row_number() over (partition by restaurant_id order by item_id) - 1 as ord, count(*) over (partition by restaurant_id) as total from usable where n = 1)
select restaurant_id, 'heuristic' as method, ord, name, null::varchar as description, shown as price, null::varchar as category from f where total >= 3"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of images per brand, named and sized by its parts; the best five."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    kinds = F.element_at(F.array(*map(F.lit, ["menu", "dish", "carte", "logo", "scan"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    tag = F.concat(F.lit('<img src="/i/'), kinds, F.lit("-"), "p_partkey", F.lit('.jpg" alt="'), F.when(F.col("p_partkey") % 4 == 0, "Dinner Menu").otherwise("photo"), F.lit('" width="'), F.col("p_size") * 40, F.lit('" height="'), F.col("p_partkey") % 30 * 50, F.lit('">'))
    rows = p.groupBy(F.concat(F.lit("https://x.example/"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")).alias("url")).agg(F.concat(F.lit("<div>pictures "), F.array_join(F.sort_array(F.collect_list(F.struct("p_partkey", tag.alias("x"))))["x"], ""), F.lit("</div>")).alias("html"))
    return ex.best_images(ex.page_images(rows)).select("url", F.col("place").cast("long").alias("place"), "image_url", F.col("score").cast("long").alias("score"))


IMAGES_SQL = """with i as (select *, 'https://x.example/' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as url, (['menu', 'dish', 'carte', 'logo', 'scan'])[p_partkey % 5 + 1] as kind, (p_size * 40)::bigint as w, p_partkey % 30 * 50 as h from part),
scored as (select url, p_partkey, 'https://x.example/i/' || kind || '-' || p_partkey || '.jpg' as image_url, case kind when 'menu' then 30 when 'dish' then -20 when 'carte' then 25 else 0 end + case when p_partkey % 4 = 0 then 25 else -15 end
  + case when h / w > 1.3 then 15 when h / w > 1.0 then 5 when h / w < 0.7 then -10 else 0 end + case when w * h > 1500000 then 5 else 0 end as score from i where w * h >= 400000 and h >= 600 and kind <> 'logo')
select url, row_number() over (partition by url order by score desc, p_partkey) as place, image_url, score::bigint as score from scored where score >= 25 qualify place <= 5"""


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits for inflected words, by text rank."""
    hits = sq.stored(spark, sf_dir).candidates("smalls rings", bridge.POINT, sq.RADIUS)
    return hits.select("restaurant_id", "item_id", F.round("rank", 6).alias("rank"), F.col("ord").cast("long").alias("ord"))


#: "small" stands in names, descriptions and categories, "ring" in names.
FULL_TEXT_SQL = f"with {sq.BRIDGE_SQL}, {sq._hits_sql('smalls rings', [['small'], ['ring']], 'smalls|rings')} select restaurant_id, item_id, round(rank, 6) as rank, ord from hits"


def dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written and read again."""
    return materialise(bridge.menu_items(spark, sf_dir))


QUERIES = {
    "wn01_item_rank": (item_rank, ITEM_RANK_SQL),
    "so06_no_words": (no_words, NO_WORDS_SQL),
    "snk05_checkpoints": (checkpoints, CHECKPOINTS_SQL),
    "snk10_sign_up": (sign_up, SIGN_UP_SQL),
    "src04_geocode": (geocoded, f"with {sq.BRIDGE_SQL} select case when rating is null then 'Old ' else '' end || place as address, case when rating is not null then round(lat, 6) end as lat, case when rating is not null then place || ' #1' end as formatted from restaurants"),
    "ag14_progress": (progress, "select user_id, count(*) as searches, count(*) * 7 + user_id as seconds, round(count(*) * 3600.0::double / (count(*) * 7 + user_id), 1) as per_hour, round(100.0::double * count(*) / 1000, 1) as percent from events group by user_id"),
    "snk13_json": (json_response, f"with {sq.BRIDGE_SQL} select restaurant_id, item_id, '{{\"item_id\":' || item_id || ',\"name\":\"' || name || '\",\"category\":\"' || category || '\"}}' as json from items"),
    "snk12_dump": (dumped, f"with {sq.BRIDGE_SQL} select * from items"),
    "sm03_failure_state": (failure_state, FAILURE_STATE_SQL),
    "sm03_stateful": (stateful_failures, FAILURE_STATE_SQL),
    "ag16_seen_once": (seen_once, "select user_id, min(event_id) as first_event from events group by user_id"),
    "sm07_answers": (answered, f"select s_suppkey as restaurant_id, case when s_suppkey % 100 <> 0 and s_suppkey % 7 <> 0 then 'menu of ' || s_name end as answer, case when s_suppkey % 100 = 0 then 'timeout' when s_suppkey % 7 = 0 then 'exception' end as error_type from supplier"),
    "sm05_results": (results_kept, RESULTS_SQL),
    "sm06_retry": (retried, RETRIED_SQL),
    "ex01_jsonld": (jsonld, JSONLD_SQL),
    "ex05_platform": (platform, PLATFORM_SQL),
    "ex08_heuristic": (heuristic, HEURISTIC_SQL),
    "ex16_images": (images, IMAGES_SQL),
    "tx01_full_text": (full_text, FULL_TEXT_SQL),
}
