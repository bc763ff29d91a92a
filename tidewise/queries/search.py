"""Queries of the search dataflow, with the same in DuckDB SQL."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.functions import text as tx
from tidewise.operators import search as s
from tidewise.operators.index import SearchIndex
from tidewise.sources.bridge import POINT, menu_items, restaurants
from tidewise.sources.shared import versions

RADIUS = 16_000.0
#: The index of each set of tables, by session and by the files that it was made from.
_INDEXES: WeakKeyDictionary[SparkSession, dict[tuple, SearchIndex]] = WeakKeyDictionary()


def stored(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The stored index of the tables; the first search over them writes it."""
    known = _INDEXES.setdefault(spark, {})
    key = versions(spark, *[f"{sf_dir}/{t}.parquet" for t in ("supplier", "lineitem", "part")])
    if key not in known:
        known[key] = SearchIndex.build(restaurants(spark, sf_dir), menu_items(spark, sf_dir))
    return known[key]

BRIDGE_SQL = f"""
restaurants as (
  select s_suppkey as restaurant_id, s_name as place, case when s_acctbal >= 0 then s_acctbal / 2000.0::double end as rating,
         32.8755::double + ((s_suppkey * 37 + 40) % 101 - 50)::double / 50.0::double * 0.2::double as lat,
         -117.2295::double + ((s_suppkey * 91 + 30) % 97 - 48)::double / 48.0::double * 0.2::double as lng
  from supplier
), near as (
  select *, {geo.distance_sql('lat', 'lng', '32.8755::double', '-117.2295::double')} as distance_m
  from restaurants
), items as (
  select distinct l_suppkey as restaurant_id, l_partkey as item_id, p_name as name, p_brand || ' ' || p_type as description, p_retailprice as price, p_type as category
  from lineitem join part on p_partkey = l_partkey
)"""


def _trigrams_sql(text: str) -> str:
    return f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+') if w <> '']))"


def _similar_sql(text: str, query: str) -> str:
    a, b = _trigrams_sql(text), _trigrams_sql(f"'{query}'")
    return f"(len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))))"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits_sql(query: str, forms: list[list[str]], names: str) -> str:
    """forms: of each query word the words of the data with its stem, none if a word has none; names: regex of the query's words and synonyms."""
    full, rank = "false", "0"
    if forms:
        full = " and ".join(f"list_has_any(t, {_list(f)})" for f in forms)
        a, b = forms
        near = "1 / (1.005 + 0.05 * exp(greatest(1, abs(i - j)) / 1.5::double - 2))"
        pairs = f"flatten([[1 - sqrt(w[i] * w[j] * {near}) for j in range(1, len(t) + 1) if list_contains({_list(b)}, t[j])] for i in range(1, len(t) + 1) if list_contains({_list(a)}, t[i])])"
        rank = f"10.0 + round(1 - list_aggregate({pairs}, 'product'), 6)"
    value = f"case when {full} then {rank} when name ilike '%{query}%' then 5.0 else {_similar_sql('name', query)} + {_similar_sql('description', query)} end::double"
    words = lambda c: f"[x for x in regexp_split_to_array(lower({c}), '[^a-z0-9]+') if x <> '']"
    weighed = " || ".join(f"[{weight}::double for x in {words(c)}]" for c, weight in (("name", 1.0), ("description", 0.4), ("category", 0.2)))
    return f"""
lexed as (
  select i.*, n.place, n.rating, n.lat, n.lng, n.distance_m, {words('name')} || {words('description')} || {words('category')} as t, {weighed} as w from items i join near n using (restaurant_id) where distance_m <= 16000
), scored as (
  select *, {value} as rank, {_similar_sql('name', query)} as sim_name, {_similar_sql('description', query)} as sim_desc, {full} as is_full from lexed
), hits as (
  select * exclude (t, w), row_number() over (order by rank desc, distance_m, restaurant_id, item_id) as ord, case when distance_m <> 0 then round(distance_m / 1609.34, 1) end as distance_miles
  from scored where is_full or name ilike '%{query}%' or sim_name > 0.15 or sim_desc > 0.15 or regexp_matches(name, '(?i)\\b({names})\\b')
  qualify ord <= 5000
)"""


#: The words of the tables' items whose stems are those of "hot plate".
_HOT_PLATE = [["hot"], ["plate"]]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places for "hot plate" by relevance; item names joined in order."""
    found = stored(spark, sf_dir).search("hot plate", POINT, RADIUS, limit=100)
    return found.select(
        F.col("position").cast("long").alias("position"),
        "restaurant_id",
        "place",
        "distance_miles",
        F.col("tier").cast("long").alias("tier"),
        F.col("eff_words").cast("long").alias("eff_words"),
        F.col("literal_words").cast("long").alias("literal_words"),
        F.round("relevance", 5).alias("relevance"),
        "total_matched_items",
        F.array_join(F.transform("matched_items", lambda x: F.concat_ws(":", x["item_id"], x["name"])), ",").alias("shown"),
        "total_results",
    )


FLAGSHIP_SQL = f"""
with {BRIDGE_SQL}, {_hits_sql('hot plate', _HOT_PLATE, 'hot|spicy|picante|plate')}, local as (
  select name from items join near using (restaurant_id) where distance_m <= 16093
), stats as (
  select count(*)::double as n, count(*) filter (regexp_matches(name, '(?i)\\bhot\\b'))::double as h, count(*) filter (regexp_matches(name, '(?i)\\bplate\\b'))::double as p,
         count(*) filter (regexp_matches(name, '(?i)\\bhot\\b') and regexp_matches(name, '(?i)\\bplate\\b'))::double as n_both from local
), weights as (
  select greatest(0, ln((n - h + 0.5) / (h + 0.5) + 1)) as idf_h, greatest(0, ln((n - p + 0.5) / (p + 0.5) + 1)) as idf_p, coalesce(n_both / nullif(h, 0), 0) as p_given_h, coalesce(n_both / nullif(p, 0), 0) as h_given_p from stats
), matched as (
  select hits.*, w.*, regexp_matches(name, '(?i)\\b(hot|spicy|picante)\\b') as nh, regexp_matches(name, '(?i)\\bplate\\b') as np,
         regexp_matches(name || ' ' || description, '(?i)\\b(hot|spicy|picante)\\b') as fh, regexp_matches(name || ' ' || description, '(?i)\\bplate\\b') as fp
  from hits, weights w
), item as (
  select *, (nh or np and h_given_p >= 0.7)::int + (np or nh and p_given_h >= 0.7)::int as eff, nh::int + np::int as literal,
         idf_h * fh::int + idf_p * fp::int + 0.5 * (idf_h * nh::int + idf_p * np::int) as rel from matched
), numbered as (
  select *, max(eff) over (partition by restaurant_id) as best, row_number() over (partition by restaurant_id order by eff desc, literal desc, rel desc, ord) as item_no,
         first_value(literal) over b as top_literal, first_value(rel) over b as top_rel, min(ord) over (partition by restaurant_id) as first_ord
  from item window b as (partition by restaurant_id order by eff desc, literal desc, rel desc, ord)
), grouped as (
  select restaurant_id, any_value(place) as place, any_value(distance_miles) as distance_miles, max(eff) as eff_words, any_value(top_literal) as literal_words, any_value(top_rel) as relevance,
         count(*) filter (eff = best) as total_matched_items, string_agg(item_id || ':' || name, ',' order by item_no) filter (eff = best and item_no <= 5) as shown, any_value(first_ord) as ord
  from numbered group by restaurant_id having max(eff) >= 1
), tiered as (
  select *, case when eff_words = 2 and case when coalesce(distance_miles, 0) = 0 then 'inf'::double else distance_miles end <= 3 then 1 else 2 end as tier from grouped
), placed as (
  select *, row_number() over (order by tier, case when tier = 1 then distance_miles else -(relevance + 0.3 * literal_words - 0.2 * coalesce(distance_miles, 100)) end,
         case when tier = 1 then -literal_words else 0 end, case when tier = 1 then -relevance else 0 end, ord) as position, count(*) over () as total_results from tiered
)
select position, restaurant_id, place, distance_miles, tier::bigint as tier, eff_words::bigint as eff_words, literal_words::bigint as literal_words, round(relevance, 5) as relevance, total_matched_items, shown, total_results
from placed where position <= 100
"""


def _other_sort(sort: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored(spark, sf_dir).search("hot plate", POINT, RADIUS, sort=sort, limit=50)
        items = F.array_join(F.transform("matched_items", lambda x: x["item_id"].cast("string")), ",")
        return found.select(F.col("position").cast("long").alias("position"), "restaurant_id", "distance_miles", F.round("rating", 6).alias("rating"), F.round("average_price", 4).alias("average_price"), items.alias("items"), "total_results")

    return query


def _other_sort_sql(key: str) -> str:
    return f"""
with {BRIDGE_SQL}, {_hits_sql('hot plate', _HOT_PLATE, 'hot|spicy|picante|plate')}, grouped as (
  select restaurant_id, any_value(distance_miles) as distance_miles, any_value(rating) as rating, avg(price) filter (price <> 0) as average_price, string_agg(item_id::varchar, ',' order by ord) as items, min(ord) as ord from hits group by restaurant_id
)
select row_number() over (order by {key}, ord) as position, restaurant_id, distance_miles, round(rating, 6) as rating, round(average_price, 4) as average_price, items, count(*) over () as total_results
from grouped qualify position <= 50
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stored(spark, sf_dir).candidates("smal rng", POINT, RADIUS)
    return hits.select("restaurant_id", "item_id", "name", F.round("rank", 6).alias("rank"), "distance_miles", F.col("ord").cast("long").alias("ord"))


CANDIDATES_SQL = f"""
with {BRIDGE_SQL}, {_hits_sql('smal rng', [], 'smal|rng')}
select restaurant_id, item_id, name, round(rank, 6) as rank, distance_miles, ord from hits
"""


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).statistics(["hot", "plate", "ring"], POINT)


WORD_COUNTS_SQL = f"""
with {BRIDGE_SQL}, local as (
  select regexp_matches(name, '(?i)\\bhot\\b') as a, regexp_matches(name, '(?i)\\bplate\\b') as b, regexp_matches(name, '(?i)\\bring\\b') as c from items join near using (restaurant_id) where distance_m <= 16093
)
select count(*) as n_items, count(*) filter (a) as n_0, count(*) filter (b) as n_1, count(*) filter (c) as n_2, count(*) filter (a and b) as n_0_1, count(*) filter (a and c) as n_0_2, count(*) filter (b and c) as n_1_2 from local
"""


def rarity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 idf of every word of the item names around the point: no list of words is needed."""
    n, total = F.col("n"), F.col("n_items")
    words = stored(spark, sf_dir).word_table(POINT)
    return words.select("word", "n", F.round(F.greatest(F.lit(0.0), F.log((total - n + 0.5) / (n + 0.5) + 1)), 6).alias("idf"))


RARITY_SQL = f"""
with {BRIDGE_SQL}, local as (
  select name, count(*) over () as total from items join near using (restaurant_id) where distance_m <= 16093
), words as (
  select word, count(*) as n, any_value(total) as total from (select unnest(list_distinct(regexp_split_to_array(lower(name), '[^a-z0-9]+'))) as word, total from local) where word <> '' group by word
)
select word, n, round(greatest(0.0, ln((total - n + 0.5) / (n + 0.5) + 1)), 6) as idf from words
"""


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = menu_items(spark, sf_dir).select("name").distinct()
    return names.select("name", F.round(tx.similarity(F.col("name"), "smal rng"), 6).alias("sim"), F.array_join(F.array_sort(tx.trigrams(F.col("name"))), "|").alias("pieces"))


SIMILARITIES_SQL = f"""
with {BRIDGE_SQL} select distinct name, round({_similar_sql('name', 'smal rng')}, 6) as sim, array_to_string(list_sort({_trigrams_sql('name')}), '|') as pieces from items
"""


def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).autocomplete("plat").select("name", F.round("sim", 6).alias("sim"))


AUTOCOMPLETE_SQL = f"""
with {BRIDGE_SQL}, named as (select distinct name, {_similar_sql('name', 'plat')} as sim from items)
select name, round(sim, 6) as sim from named where name ilike '%plat%' or sim > 0.15 order by named.sim desc, name limit 10
"""


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = s.detail(restaurants(spark, sf_dir), menu_items(spark, sf_dir), 7)
    return d.select("restaurant_id", "name", F.size(F.coalesce("menu_items", F.array())).cast("long").alias("n_items"), F.array_join(F.transform("menu_items", lambda x: x["item_id"].cast("string")), ",").alias("items"))


DETAIL_SQL = f"""
with {BRIDGE_SQL} select r.restaurant_id, any_value(place) as name, count(item_id) as n_items, string_agg(item_id::varchar, ',' order by item_id) as items
from restaurants r left join items i on r.restaurant_id = i.restaurant_id where r.restaurant_id = 7 group by r.restaurant_id
"""


def word_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words beyond ASCII, over whole texts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.where(tx.whole_word(F.col("text"), ["für", "ción", "the"])).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


WORD_IN_DOCUMENTS_SQL = r"""
select lang, count(*) as n, sum(n_chars)::bigint as chars from documents where regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])(für|ción|the)($|[^\p{L}\p{M}\p{N}_])') group by lang
"""

def places_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within the radius, from the files of the cells that it touches."""
    return stored(spark, sf_dir).near(POINT, 9_000.0).select("restaurant_id", F.round("distance_m", 2).alias("distance_m"))


PLACES_NEAR_SQL = f"with {BRIDGE_SQL} select restaurant_id, round(distance_m, 2) as distance_m from near where distance_m <= 9000"


def posting_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text ranks of all texts with the stems of the query, from postings alone."""
    index = stored(spark, sf_dir)
    found = index.text_ranks("rings of plates").join(index.texts.select("region", "text_id", "name", "description"), ["region", "text_id"])
    return found.select("name", "description", F.round("rank", 6).alias("rank")).distinct()


POSTING_RANKS_SQL = f"""with {BRIDGE_SQL},
all_texts as (select distinct name, description, category from items), words as (
  select name, description, {' || '.join(f"[x for x in regexp_split_to_array(lower({c}), '[^a-z0-9]+') if x <> '']" for c in ('name', 'description', 'category'))} as t,
         {' || '.join(f"[{w}::double for x in regexp_split_to_array(lower({c}), '[^a-z0-9]+') if x <> '']" for c, w in (('name', 1.0), ('description', 0.4), ('category', 0.2)))} as w from all_texts
)
select distinct name, description, round(1 - list_aggregate(flatten([[1 - sqrt(w[i] * w[j] * (1 / (1.005 + 0.05 * exp(greatest(1, abs(i - j)) / 1.5::double - 2)))) for j in range(1, len(t) + 1) if t[j] = 'plate'] for i in range(1, len(t) + 1) if t[i] = 'ring']), 'product'), 6) as rank
from words where list_contains(t, 'ring') and list_contains(t, 'plate')"""


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts of word pairs by cell, added up over all cells."""
    both = stored(spark, sf_dir).counts.where("other is not null")
    return both.groupBy("word", "other").agg(F.sum("n").alias("n"))


WORD_PAIRS_SQL = f"""with {BRIDGE_SQL}, w as (
  select restaurant_id, item_id, unnest(list_distinct(regexp_split_to_array(lower(name), '[^a-z0-9]+'))) as word from items
)
select a.word, b.word as other, count(*) as n from w a join w b on a.restaurant_id = b.restaurant_id and a.item_id = b.item_id and a.word < b.word group by a.word, b.word"""

_FAR = "case when coalesce(distance_miles, 0) = 0 then 'inf'::double else distance_miles end"
QUERIES = {
    "so05_tiered": (flagship, FLAGSHIP_SQL),
    "so02_distance": (_other_sort("distance"), _other_sort_sql(_FAR)),
    "so03_rating": (_other_sort("rating"), _other_sort_sql("-coalesce(rating, 0)")),
    "so04_price_low": (_other_sort("price_low"), _other_sort_sql("coalesce(average_price, 'inf'::double)")),
    "so04_price_high": (_other_sort("price_high"), _other_sort_sql("-coalesce(average_price, 0)")),
    "so01_candidates": (candidates, CANDIDATES_SQL),
    "ag02_word_counts": (word_counts, WORD_COUNTS_SQL),
    "ag04_rarity": (rarity_table, RARITY_SQL),
    "tx05_similarity": (similarities, SIMILARITIES_SQL),
    "so08_autocomplete": (autocomplete, AUTOCOMPLETE_SQL),
    "jn04_detail": (detail, DETAIL_SQL),
    "flt01_places_near": (places_near, PLACES_NEAR_SQL),
    "tx04_posting_ranks": (posting_ranks, POSTING_RANKS_SQL),
    "ag04_word_pairs": (word_pairs, WORD_PAIRS_SQL),
    "flt05_whole_word": (word_in_documents, WORD_IN_DOCUMENTS_SQL),
}
