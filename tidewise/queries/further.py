"""Queries of the place source, pages for models, images, retries, trials, coordinates and the whole cascade on built sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.functions import text as tx
from tidewise.operators import accounts, ingest, reports
from tidewise.operators import extract as ex
from tidewise.operators import search as s
from tidewise.plans.cascade import scrape
from tidewise.queries import more as mq
from tidewise.queries import pages as pq
from tidewise.queries import search as sq
from tidewise.queries import service as vq
from tidewise.sources import bridge


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the hand-placed grid, and of one that is made, of one metro, with the number of places within 3 km."""
    placed, made = bridge.metro_grid(spark, "san_diego"), bridge.metro_grid(spark, "san_diego", 5.0)
    points = placed.select("label", "lat", "lng", F.lit("placed").alias("kind")).unionByName(made.select("label", "lat", "lng", F.lit("made").alias("kind")))
    near = geo.nearby_pairs(points, bridge.restaurants(spark, sf_dir).select("restaurant_id", "lat", "lng"), 3000.0).groupBy("label", "kind").agg(F.count("*").alias("n"))
    return points.join(near, ["label", "kind"], "left").select("label", "lat", "lng", "kind", F.coalesce("n", F.lit(0)).alias("n_places"))


_PLACED = "placed as (select * from (values " + ", ".join(f"('{label}', {lat}::double, {lng}::double)" for lat, lng, label in bridge.SAN_DIEGO) + ") as t(label, lat, lng))"
_SAN_DIEGO = next(m for m in bridge.METROS if m[0] == "san_diego")
CURATED_SQL = f"""with {sq.BRIDGE_SQL}, {_PLACED}, {vq.GRID_SQL.replace(vq.METROS_SQL, "metros as (select 'san_diego' as name, {3}::double as sw_lat, {4}::double as sw_lng, {5}::double as ne_lat, {6}::double as ne_lng)".format(*_SAN_DIEGO))},
points as (select *, 'placed' as kind from placed union all select metro || '_' || row || '_' || col, lat, lng, 'made' from grid)
select label, p.lat, p.lng, kind, count(restaurant_id) as n_places from points p left join restaurants r on {geo.distance_sql('p.lat', 'p.lng', 'r.lat', 'r.lng')} <= 3000 group by label, p.lat, p.lng, kind"""

_SERVED = ["mexican", "pizza", "sushi"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to searches for any food and for pizza at the hand-placed points; a place serves one of three foods."""
    serves = F.array(F.element_at(F.array(*map(F.lit, _SERVED)), (F.col("restaurant_id") % 3 + 1).cast("int")))
    places = bridge.restaurants(spark, sf_dir).select(F.col("restaurant_id").alias("place_id"), "lat", "lng", serves.alias("serves"))
    searches = bridge.metro_grid(spark, "san_diego").select("label", "lat", "lng", F.explode(F.array(F.lit(""), F.lit("pizza"))).alias("food_type"))
    return bridge.nearby_answers(searches, places, 5000.0).select("label", "query", F.col("place_place_id").alias("place_id"), F.col("place").cast("long").alias("place"))


ANSWERS_SQL = f"""with {sq.BRIDGE_SQL}, {_PLACED}, found as (
  select label, food_type, trim(food_type || ' restaurants') as query, restaurant_id as place_id,
         {geo.distance_sql('p.lat', 'p.lng', 'r.lat', 'r.lng')} as d
  from placed p cross join (values (''), ('pizza')) as f(food_type) cross join restaurants r where food_type = '' or ({_SERVED!r})[restaurant_id % 3 + 1] = food_type
)
select label, query, place_id, row_number() over (partition by label, food_type order by d, place_id) as place from found where d <= 5000 qualify place <= 20"""


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which form of a page is read: long pages, shells with and without a rendered form, failed reads with an archived one, pages that are gone."""
    long, shell = F.repeat(F.concat(F.lit("<p>"), F.col("s_name"), F.lit("</p>")), F.lit(60)), F.concat(F.lit("<script>app()</script><p>"), F.col("s_name"), F.lit("</p>"))
    kind = F.col("s_suppkey") % 5
    pages = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        "s_suppkey",
        F.when(kind == 3, None).when((kind == 1) | (kind == 2), shell).otherwise(long).alias("html"),
        F.when(kind == 1, F.concat(F.lit("<main>"), long)).alias("rendered"),
        F.when(kind == 3, F.concat(F.lit("<old>"), long)).alias("archived"),
        F.when(kind == 4, 404).when(kind == 3, 503).otherwise(200).alias("status"),
        F.concat(F.lit("https://archive.example/web/2024/http://x/http/"), "s_suppkey").alias("url"),
    )
    page = ex.page_html(F.col("html"), F.col("rendered"), F.col("archived"), F.col("status"))
    light = ex.light_html(F.col("html"), F.when(F.col("status") >= 400, F.lit("status")))
    return pages.select("s_suppkey", F.length(page).cast("long").alias("n_page"), F.length(light).cast("long").alias("n_light"), F.length(ex.selector_html(page)).cast("long").alias("n_selectors"), F.length(ex.model_text(ex.visible_text(page))).cast("long").alias("n_model"), ex.archive_url(F.col("url")).alias("raw_url"))


READ_PAGES_SQL = """with p as (select s_suppkey, s_suppkey % 5 as k, length(s_name) as n from supplier), q as (
  select *, case k when 0 then 60 * (n + 7) when 1 then 60 * (n + 7) + 6 when 2 then n + 29 when 3 then 60 * (n + 7) + 5 end::bigint as n_page, case when k = 2 then n else 60 * n end as n_text from p)
select s_suppkey, n_page, case k when 0 then n_page end as n_light, case when n_page is not null then least(n_page, 3000) end as n_selectors, case when k <> 4 and n_text >= 200 then n_text::bigint end as n_model, 'https://archive.example/web/2024id_/http://x/http/' || s_suppkey as raw_url from q"""


def image_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read from images, an image per brand and size, a site per brand; prices are missing for most parts of some sizes."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.when((F.col("p_size") % 3 == 0) | (F.col("p_partkey") % 7 == 0), F.col("p_retailprice"))
    read = p.select(F.col("p_brand").alias("site"), (F.col("p_size") % 4).alias("image_no"), F.col("p_partkey").alias("pos"), F.concat(F.upper("p_name"), F.lit(" "), F.col("p_partkey") % 40).alias("name"), price.alias("price"))
    kinds = F.element_at(F.array(*map(F.lit, ["image/png", "image/webp; q=1", "text/html"])), (F.col("pos") % 3 + 1).cast("int"))
    return ex.image_items(read).select("site", F.col("image_no").cast("long").alias("image_no"), "pos", "name", "price", ex.media_type(kinds).alias("kind"))


IMAGE_ITEMS_SQL = """with read as (select p_brand as site, p_size % 4 as image_no, p_partkey as pos, upper(p_name) || ' ' || p_partkey % 40 as name, case when p_size % 3 = 0 or p_partkey % 7 = 0 then p_retailprice end as price from part),
good as (select site, image_no from read group by all having count(price) >= 3 or count(price) >= 0.3 * count(*)),
kept as (select r.* from read r join good using (site, image_no) qualify row_number() over (partition by site, lower(name) order by image_no, pos) = 1)
select site, image_no::bigint as image_no, pos, name, price, (['image/png', 'image/webp', 'image/jpeg'])[pos % 3 + 1] as kind from kept qualify count(*) over (partition by site) >= 3"""


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest pages of each host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"), F.col("page_id").alias("rank"), "html")
    return ex.longest_pages(pages).select("site", F.col("rank").alias("page_id"), F.col("place").cast("long").alias("place"))


LONGEST_SQL = "select regexp_extract(url, '^https?://([^/?#]+)', 1) as site, page_id, row_number() over (partition by site order by length(html) desc, page_id) as place from pages qualify place <= 3"


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.retry_report(bridge.failures(spark, sf_dir), bridge.restaurants(spark, sf_dir))
    return found.select("error_type", "n", F.col("place").cast("long").alias("place"))


RETRIES_SQL = f"with {sq.BRIDGE_SQL}, {vq.FAILURES_SQL} select error_type, count(*) as n, row_number() over (order by count(*) desc, error_type) as place from failures join restaurants using (restaurant_id) where not resolved group by error_type"


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search_totals(vq.search_plan(spark, sf_dir))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions after sign-up: those before, and a trial for each new user."""
    users = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("user_id"), F.concat(F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")), F.lit("@mail.example")).alias("email"))
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + 1_000_000).alias("user_id"), F.concat(F.lit(" "), "c_name", F.when(F.col("c_custkey") % 5 != 0, "@MAIL.example ").otherwise("mail")).alias("email"))
    found = accounts.sign_up(users, bridge.subscriptions(spark, sf_dir), new, vq.now())[1]
    return found.select("user_id", "tier", "external_id", F.unix_timestamp("expires_at").alias("expires"), "is_active")


TRIALS_SQL = f"""with {vq.SUBSCRIPTIONS_SQL}, users as ({mq.SIGN_UP_SQL})
select user_id, tier, external_id, floor(epoch(expires_at))::bigint as expires, is_active from subscriptions
union all select user_id, 'trial', null, epoch({vq.NOW_SQL} + interval 7 days)::bigint, true from users where user_id > 1000000"""


def single_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only price of texts of several shapes."""
    return pq._price_texts(spark, sf_dir).select("p_partkey", tx.price_single(F.col("x")).alias("price"))


SINGLE_PRICES_SQL = rf"""with {pq._PRICE_TEXTS_SQL}, found as (
  select p_partkey, regexp_extract_all(x, '\$\s*(\d{{1,4}}(?:,\d{{3}})*(?:\.\d{{1,2}})?)', 1) as dollars, [substr(y, 2, length(y) - 2) for y in regexp_extract_all(' ' || replace(x, ' ', '  ') || ' ', '[^0-9]\d{{1,3}}\.\d\d[^0-9]')] as bare from price_texts)
select p_partkey, try_cast(replace(case when len(dollars) = 1 then dollars[1] when len(bare) = 1 then bare[1] end, ',', '') as double) as price from found"""


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the places of a search's result are."""
    hits = sq.stored(spark, sf_dir).candidates("hot plate", bridge.POINT, sq.RADIUS)
    return s.rank_places(hits, 2, "distance").select("restaurant_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


COORDINATES_SQL = f"with {sq.BRIDGE_SQL}, {sq._hits_sql('hot plate', sq._HOT_PLATE, 'hot|spicy|picante|plate')} select distinct restaurant_id, round(lat, 6) as lat, round(lng, 6) as lng from hits"


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all places, marked where a search found them."""
    hits = sq.stored(spark, sf_dir).candidates("hot plate", bridge.POINT, sq.RADIUS)
    return s.flagged(bridge.menu_items(spark, sf_dir), hits, ["restaurant_id", "item_id"]).select("restaurant_id", "item_id", "is_match")


MATCHED_SQL = f"""with {sq.BRIDGE_SQL}, {sq._hits_sql('hot plate', sq._HOT_PLATE, 'hot|spicy|picante|plate')}
select i.restaurant_id, i.item_id, h.item_id is not null as is_match from items i left join hits h on h.restaurant_id = i.restaurant_id and h.item_id = i.item_id"""


def defaulted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a search's result looked up among rated places only; the others stand at the query's point."""
    hits = sq.stored(spark, sf_dir).candidates("hot plate", bridge.POINT, sq.RADIUS).select("restaurant_id").distinct()
    found = s.located(hits, bridge.restaurants(spark, sf_dir).where("rating is not null"), bridge.POINT)
    return found.select("restaurant_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


DEFAULTED_SQL = f"""with {sq.BRIDGE_SQL}, {sq._hits_sql('hot plate', sq._HOT_PLATE, 'hot|spicy|picante|plate')}
select distinct restaurant_id, round(case when rating is null then {bridge.POINT[0]} else lat end, 6) as lat, round(case when rating is null then {bridge.POINT[1]} else lng end, 6) as lng from hits"""


def ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of reads that a timeout or an error ended."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_id") % 3 == 0, "timeout").when(F.col("event_id") % 3 == 1, F.col("event_type")).alias("error"))
    return e.select("event_id", ingest.failure_type(F.lit("none"), F.lit("toast"), F.col("error")).alias("failure"))


_LONG = "<p>" + "long text of a page without any list " * 20 + "</p>"
_LD = '<script type="application/ld+json">{"@type":"Menu","hasMenuItem":[{"@type":"MenuItem","name":"Pie"},{"@type":"MenuItem","name":"Cake"},{"@type":"MenuItem","name":"Ice"}]}</script>'
_PRICED = "<div>Edamame $5.50</div><div>Ramen Bowl $14</div><div>Gyoza 7.25</div><div>Mochi $4.00</div>"
_ROWS = "<table><tr><td>Soup</td><td>$4.00</td></tr><tr><td>Rice Plate</td><td>$9.50</td></tr><tr><td>Noodles</td><td>$11.00</td></tr><tr><td>Tea</td><td>$2.50</td></tr><tr><td>Beans</td><td>$3</td></tr></table>"
_TEXT = "Soup of the day 4.00\nRice with beans 5.00\nNoodles in broth 6.50\nopen every day from noon until late at night"


def built_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site per supplier of one of seven kinds: structured data, a linked PDF, a linked page, a page behind a linked page, an archived page, nothing, no page at all."""
    sites = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example")).alias("site"), (F.col("s_suppkey") % 7).alias("kind"))
    page = lambda kind, path, html, archived=None: (kind, path, None if html is None else html + _LONG, archived)
    forms = spark.createDataFrame(
        [
            page(0, "", _LD),
            page(1, "", '<a href="/menu.pdf">list</a>'),
            page(2, "", '<a href="/food">food</a>'),
            page(2, "/food", _PRICED),
            page(3, "", '<a href="/menu">menu</a>'),
            page(3, "/menu", '<a href="/menu/dinner">dinner</a>'),
            page(3, "/menu/dinner", _ROWS),
            page(4, "", None, _LD + _LONG),
            page(5, "", "<b>closed</b>"),
        ],
        "kind long, path string, html string, archived_html string",
    )
    pages = sites.join(forms, "kind").select(F.concat("site", "path").alias("url"), "html", F.lit(None).cast("string").alias("rendered_html"), "archived_html")
    texts = sites.where("kind = 1").select(F.concat("site", F.lit("/menu.pdf")).alias("url"), F.lit(_TEXT).alias("text"))
    return scrape(sites.select("site"), pages, texts)[0]


BUILT_CASCADE_SQL = """select 'https://s' || s_suppkey || '.example' as site, case when k = 6 then 'unknown' else 'custom' end as platform_type,
(['structured_data', 'pdf', 'heuristic', 'heuristic', 'structured_data', 'free_exhausted', 'none'])[k + 1] as method, ([3, 3, 4, 5, 3, 0, 0])[k + 1]::bigint as n_items, k < 5 as used_pattern,
case k when 5 then 'free_only_skip' when 6 then 'bot_blocked' end as failure from (select s_suppkey, s_suppkey % 7 as k from supplier)"""

def _element(selector: str, inner: str) -> str:
    """An element, or some inside each other, that a selector finds."""
    for part in reversed(selector.split()):
        if part.startswith("["):
            name, value = part.strip("[]").replace("*", "").split("=")
            inner = f"<div {name}={value}>{inner}</div>"
        elif part.startswith("."):
            inner = f'<div class="{part[1:]}">{inner}</div>'
        else:
            inner = f"<{part}>{inner}</{part}>"
    return inner


_SETS = [(name, n, box, parts) for name, sets in ex.PLATFORM_SELECTORS.items() for n, (box, *parts) in enumerate(sets)]


def selector_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of three items for every place, by one of all platforms' sets of selectors after another."""
    item = lambda box, parts, k: _element(box, "".join(_element(p, text) for p, text in zip(parts, (f"Dish {k} of @", f"${k}.50", "served with bread"))))
    of = F.element_at(F.array(*[F.struct(F.lit(name).alias("platform_type"), F.lit("".join(item(box, parts, k) for k in (1, 2, 3))).alias("page")) for name, _, box, parts in _SETS]), (F.col("restaurant_id") % len(_SETS) + 1).cast("int"))
    pages = bridge.restaurants(spark, sf_dir).withColumn("of", of).select(F.col("restaurant_id").cast("string").alias("url"), "of.platform_type", F.replace("of.page", F.lit("@"), "name").alias("html"))
    found = ex.extract_free(pages)
    return found.select("url", "platform_type", "method", F.col("ord").cast("long").alias("ord"), "name", "description", "price")


SELECTOR_SETS_SQL = f"""select s_suppkey::varchar as url, ({[name for name, *_ in _SETS]!r})[s_suppkey % {len(_SETS)} + 1] as platform_type, 'platform' as method, k - 1 as ord, 'Dish ' || k || ' of ' || s_name as name, 'served with bread' as description, k + 0.5::double as price
from supplier, range(1, 4) as r(k)"""

QUERIES = {
    "ex05_selector_sets": (selector_sets, SELECTOR_SETS_SQL),
    "ge06_curated_grid": (curated, CURATED_SQL),
    "src02_answers": (answers, ANSWERS_SQL),
    "src07_read_pages": (read_pages, READ_PAGES_SQL),
    "ex17_image_items": (image_items, IMAGE_ITEMS_SQL),
    "so11_longest_pages": (longest, LONGEST_SQL),
    "sm06_retry_report": (retries, RETRIES_SQL),
    "ag12_search_totals": (search_totals, f"with {vq.GRID_SQL} select count(*) as points, count(*) * 12 as core_searches, count(*) * 34 as full_searches, count(*) * 12 // 8000 + 1 as months from grid"),
    "snk10_trials": (trials, TRIALS_SQL),
    "px02_single_prices": (single_prices, SINGLE_PRICES_SQL),
    "jn03_coordinates": (coordinates, COORDINATES_SQL),
    "st07_matched": (matched, MATCHED_SQL),
    "jn03_default_point": (defaulted, DEFAULTED_SQL),
    "ex24_ended": (ended, "select event_id, case event_id % 3 when 0 then 'timeout' when 1 then 'exception' else 'extraction_fail' end as failure from events"),
    "ex21_built_cascade": (built_cascade, BUILT_CASCADE_SQL),
}
