"""Search for items near a point and ranking of the places that offer them, as one DataFrame plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.functions import text as tx
from tidewise.functions.fulltext import indexed, text_rank
from tidewise.functions.synonyms import expand
from tidewise.sources.shared import materialise

STATISTICS_M = 16_093.0
SIMILAR = 0.15
CO_OCCURRENCE = 0.7
NEAR_MILES = 3.0
SORTS = ("relevance", "distance", "rating", "price_low", "price_high")


def check_arguments(query: str, point: tuple[float, float], radius_m: float, sort: str, limit: int) -> None:
    """ValueError for what a search refuses."""
    if not 1 <= len(query) <= 200:
        raise ValueError("query: 1 to 200 characters")
    if not (-90 <= point[0] <= 90 and -180 <= point[1] <= 180):
        raise ValueError("point: latitude -90 to 90, longitude -180 to 180")
    if not 100 <= radius_m <= 25_000:
        raise ValueError("radius_m: 100 to 25000")
    if sort not in SORTS:
        raise ValueError(f"sort: one of {', '.join(SORTS)}")
    if not 1 <= limit <= 100:
        raise ValueError("limit: 1 to 100")


def near(restaurants: DataFrame, point: tuple[float, float], radius_m: float) -> DataFrame:
    """Places within the radius, with distance_m."""
    distance = geo.distance_m(F.col("lat"), F.col("lng"), F.lit(float(point[0])), F.lit(float(point[1])))
    return restaurants.where(geo.within_radius(F.col("lat"), F.col("lng"), point, radius_m)).withColumn("distance_m", distance)


def word_match(query: str) -> Column:
    """All words of the query, but for ignored ones, among the words of name, description and category."""
    words = [w for w in query.lower().split() if w not in tx.STOP_WORDS]
    if not words:
        return F.lit(False)
    own = tx.alnum_words(F.concat_ws(" ", "name", "description", "category"))
    return F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(own, w))


def score(query: str, groups: list[list[str] | str] | None = None, stemmed: bool = True) -> tuple[dict[str, Column], Column, Column]:
    """(columns to compute first, rank, whether a row matches) over name, description, category and lexemes.

    All words in any inflection 10 plus their text rank (without `stemmed`: as whole words, 10), the query as a part of the name 5, or
    else the similarities of name and description. Similarity above 0.15 or any word of the name is enough to match.
    """
    name = F.col("name")
    first = {
        "_by_name": tx.similarity(name, query),
        "_by_description": F.coalesce(tx.similarity(F.col("description"), query), F.lit(0.0)),
        "_full": 10.0 + text_rank(F.col("lexemes"), query) if stemmed else F.when(word_match(query), 10.0),
    }
    part = tx.contains_ci(name, query)
    words = [tx.whole_word(name, list(s)) for s in expand(tx.query_tokens(query), groups).values()]
    match = reduce(lambda a, b: a | b, [F.col("_full").isNotNull(), part, F.col("_by_name") > SIMILAR, F.col("_by_description") > SIMILAR, *words])
    return first, F.coalesce("_full", F.when(part, 5.0).otherwise(F.col("_by_name") + F.col("_by_description"))), match


def local_items(restaurants: DataFrame, items: DataFrame, point: tuple[float, float], radius_m: float) -> tuple[DataFrame, DataFrame]:
    """(items of the places within the radius, these places with their distance_m), both written: all of a search reads only these.

    The places come first, so that their number decides how the items are joined and no rule derives a distance test for the items.
    """
    places = materialise(near(restaurants, point, radius_m).withColumnRenamed("name", "place"))
    return materialise(items.join(places.select("restaurant_id"), "restaurant_id")), places


def candidates(restaurants: DataFrame, items: DataFrame, query: str, point: tuple[float, float], radius_m: float, groups: list[list[str] | str] | None = None, hit_cap: int = 5000, stemmed: bool = True) -> DataFrame:
    """The best `hit_cap` item hits near the point, with rank, distance_m, distance_miles and ord (1 is the best).

    The cap is part of the search: hits are cut before they are grouped by place. Items may bring their lexemes (`indexed`).
    """
    return _hits(*local_items(restaurants, items, point, radius_m), query, groups, hit_cap, stemmed)


def _hits(local: DataFrame, places: DataFrame, query: str, groups: list[list[str] | str] | None, hit_cap: int, stemmed: bool) -> DataFrame:
    """Every different text is read and scored once; items without their own lexemes get them here."""
    fields = ["name", "description", "category", *["lexemes"] * ("lexemes" in local.columns)]
    first, rank, match = score(query, groups, stemmed)
    texts = local.select(*fields).distinct()
    if stemmed and "lexemes" not in fields:
        texts = indexed(texts)
    scored = texts.withColumns(first).where(match).select(*fields[:3], rank.alias("rank"))
    same = reduce(lambda a, b: a & b, [F.col(f"i.{f}").eqNullSafe(F.col(f"t.{f}")) for f in fields[:3]])
    return best_hits(local.drop("lexemes").alias("i").join(scored.alias("t"), same).select("i.*", "rank").join(places, "restaurant_id"), hit_cap)


def best_hits(hits: DataFrame, hit_cap: int) -> DataFrame:
    """The best `hit_cap` of hits with rank and distance_m, with ord and distance_miles."""
    order = [F.col("rank").desc(), F.col("distance_m"), F.col("restaurant_id"), F.col("item_id")]
    hits = hits.orderBy(*order).limit(hit_cap).withColumn("ord", F.row_number().over(Window.orderBy(*order)))
    return hits.withColumn("distance_miles", geo.miles(F.col("distance_m")))


def word_statistics(restaurants: DataFrame, items: DataFrame, words: list[str], point: tuple[float, float]) -> DataFrame:
    """One row over all items around the point: n_items, n_0 … per word, and n_i_j per pair of words, in one pass."""
    places = materialise(near(restaurants, point, STATISTICS_M).select("restaurant_id"))
    return _statistics(items.join(places, "restaurant_id"), words)


def _statistics(local: DataFrame, words: list[str], times: str | None = None) -> DataFrame:
    """Counts over rows with name, each as often as the column `times` says."""
    words = list(dict.fromkeys(words))
    n = F.lit(1) if times is None else F.col(times)
    local = local.select(n.cast("long").alias("n"), *[tx.whole_word(F.col("name"), [w]).alias(f"h{i}") for i, w in enumerate(words)])
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    ones = [total(F.col(f"h{i}")).alias(f"n_{i}") for i in range(len(words))]
    pairs = [total(F.col(f"h{i}") & F.col(f"h{j}")).alias(f"n_{i}_{j}") for i in range(len(words)) for j in range(i + 1, len(words))]
    return local.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), *ones, *pairs)


def rarity(stats: dict[str, int], words: list[str]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """(idf of each word, P(other word given word)) from a row of word_statistics."""
    import math

    words = list(dict.fromkeys(words))
    n = stats["n_items"]
    count = [stats[f"n_{i}"] for i in range(len(words))]
    idf = {w: max(0.0, math.log((n - c + 0.5) / (c + 0.5) + 1)) if n else 0.0 for w, c in zip(words, count)}
    both = lambda i, j: stats[f"n_{min(i, j)}_{max(i, j)}"]
    given = {w: {o: both(i, j) / count[i] for j, o in enumerate(words) if i != j} for i, w in enumerate(words) if count[i]}
    return idf, given


def item_scores(hits: DataFrame, words: list[str], idf: dict[str, float], given: dict[str, dict[str, float]], groups: list[list[str] | str] | None = None, co_occurrence: float = CO_OCCURRENCE) -> DataFrame:
    """hits with eff (different words that the name has or implies), literal (words that it has) and rel (rarity of words)."""
    synonyms = expand(words, groups)
    name, full = F.col("name"), F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))
    hits = hits.withColumns({f"_n{i}": tx.whole_word(name, list(synonyms[w])) for i, w in enumerate(words)} | {f"_f{i}": tx.whole_word(full, list(synonyms[w])) for i, w in enumerate(words)})
    one = lambda c: F.col(c).cast("int")
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    effective = []
    for i, w in enumerate(words):
        if w in words[:i]:
            continue
        implied = [F.col(f"_n{j}") for j, o in enumerate(words) if o != w and given.get(o, {}).get(w, 0.0) >= co_occurrence]
        effective.append(reduce(lambda a, b: a | b, implied, F.col(f"_n{i}")).cast("int"))
    rel = total([F.lit(idf.get(w, 0.0)) * one(f"_f{i}") for i, w in enumerate(words)]) + 0.5 * total([F.lit(idf.get(w, 0.0)) * one(f"_n{i}") for i, w in enumerate(words)])
    scored = hits.withColumns({"eff": total(effective), "literal": total([one(f"_n{i}") for i in range(len(words))]), "rel": rel})
    return scored.drop(*[f"_{k}{i}" for k in "nf" for i in range(len(words))])


def rank_items(scored: DataFrame, most: int = 5) -> DataFrame:
    """Items with the best eff of their place (1 at least), numbered by item_no, of `n_kept`; the first `most` are shown."""
    place = Window.partitionBy("restaurant_id")
    best = scored.withColumn("_best", F.max("eff").over(place)).where((F.col("eff") == F.col("_best")) & (F.col("_best") >= 1)).drop("_best")
    order = place.orderBy(F.col("eff").desc(), F.col("literal").desc(), F.col("rel").desc(), "ord")
    return best.withColumns({"item_no": F.row_number().over(order), "n_kept": F.count("*").over(place)}).where(F.col("item_no") <= most)


def _listed(hits: DataFrame, order: Column) -> Column:
    one = F.struct(order.alias("no"), F.col("item_id"), F.col("name"), F.col("description"), F.col("price"), F.col("category"))
    return F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[c].alias(c) for c in ("item_id", "name", "description", "price", "category")])).alias("matched_items")


_PLACE = ("place", "rating", "lat", "lng", "distance_miles")


def rank_places(hits: DataFrame, n_words: int, sort: str = "relevance", most: int = 5) -> DataFrame:
    """One row per place in order (position), from hits with ord and, for relevance, the scores of item_scores.

    Relevance has two tiers. Tier 1: every word, at most 3 miles away, by distance. Tier 2: by rarity, matched words and distance.
    Other orders keep all items. A distance of 0 miles counts as unknown.
    """
    far = F.when(F.coalesce("distance_miles", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("distance_miles"))
    place = [F.first(c).alias(c) for c in _PLACE]
    if sort == "relevance" and n_words:
        top = F.max(F.struct("eff", "literal", "rel")).alias("top")
        kept = rank_items(hits, most)
        shown = kept.groupBy("restaurant_id").agg(_listed(kept, F.col("item_no")), F.first("n_kept").alias("total_matched_items"))
        rows = hits.groupBy("restaurant_id").agg(top, F.min("ord").alias("ord"), *place).join(shown, "restaurant_id")
        rows = rows.select("*", F.col("top.eff").alias("eff_words"), F.col("top.literal").alias("literal_words"), F.col("top.rel").alias("relevance")).drop("top")
        first = (F.col("eff_words") == n_words) & (far <= NEAR_MILES)
        rows = rows.withColumn("tier", F.when(first, 1).otherwise(2))
        value = F.col("relevance") + 0.3 * F.col("literal_words") - 0.2 * F.coalesce("distance_miles", F.lit(100.0))
        keys = [F.col("tier"), F.when(first, far).otherwise(-value), F.when(first, -F.col("literal_words")).otherwise(0), F.when(first, -F.col("relevance")).otherwise(0.0), F.col("ord")]
    else:
        rows = hits.groupBy("restaurant_id").agg(F.min("ord").alias("ord"), _listed(hits, F.col("ord")), F.avg(F.when(F.col("price") != 0, F.col("price"))).alias("average_price"), F.count("*").alias("n_hits"), *place)
        rows = rows.withColumn("total_matched_items", F.lit(0).cast("long"))
        keys = {
            "relevance": [-F.col("n_hits"), far],
            "distance": [far],
            "rating": [-F.coalesce("rating", F.lit(0.0))],
            "price_low": [F.coalesce("average_price", F.lit(float("inf")))],
            "price_high": [-F.coalesce("average_price", F.lit(0.0))],
        }[sort]
        keys.append(F.col("ord"))
    return rows.withColumns({"position": F.row_number().over(Window.orderBy(*keys)), "total_results": F.count("*").over(Window.partitionBy(F.lit(0)))})


def search(restaurants: DataFrame, items: DataFrame, query: str, point: tuple[float, float], radius_m: float = 5000.0, sort: str = "relevance", limit: int = 20, groups: list[list[str] | str] | None = None, hit_cap: int = 5000, stemmed: bool = True) -> DataFrame:
    """The first `limit` places for a query, best first by position, each with its matched items."""
    check_arguments(query, point, radius_m, sort, limit)
    words = tx.query_tokens(query)
    counted = sort == "relevance" and words
    local, places = local_items(restaurants, items, point, max(radius_m, STATISTICS_M) if counted else radius_m)
    hits = materialise(_hits(local, places.where(F.col("distance_m") <= radius_m), query, groups, hit_cap, stemmed))  # hit_cap rows, read several times
    if counted:
        # one row of 1 + w + w (w - 1) / 2 counts over the local items
        around = local if radius_m <= STATISTICS_M else local.join(places.where(F.col("distance_m") <= STATISTICS_M).select("restaurant_id"), "restaurant_id")
        stats = _statistics(around, words).first().asDict()
        hits = item_scores(hits, words, *rarity(stats, words), groups=groups)
    return rank_places(hits, len(words), sort).where(F.col("position") <= limit)


def autocomplete(items: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The n different names most similar to the query, of those that contain it, resemble it or have its words. Every different text is looked at once."""
    sim = tx.similarity(F.col("name"), query)
    match = tx.contains_ci(F.col("name"), query) | (sim > SIMILAR) | word_match(query)
    return items.select("name", "description", "category").distinct().where(match).select("name", sim.alias("sim")).distinct().orderBy(F.col("sim").desc(), "name").limit(n)


def detail(restaurants: DataFrame, items: DataFrame, restaurant_id) -> DataFrame:
    """One place with all its items; a place without items stays."""
    one = F.struct("item_id", "name", "description", "price", "category")
    menu = items.where(F.col("restaurant_id") == restaurant_id).groupBy("restaurant_id").agg(F.array_sort(F.collect_list(one)).alias("menu_items"))
    return restaurants.where(F.col("restaurant_id") == restaurant_id).join(menu, "restaurant_id", "left")


def as_json(rows: DataFrame, fields: list[str]) -> Column:
    """The fields of a row as the JSON text of an answer."""
    return F.to_json(F.struct(*[rows[c] for c in fields]))


def flagged(items: DataFrame, matched: DataFrame, key: str | list[str] = "item_id") -> DataFrame:
    """items with is_match, whether their key is among those of matched (a detail page marks what a search found)."""
    keys = [key] if isinstance(key, str) else key
    known = matched.select(*keys).distinct().withColumn("is_match", F.lit(True))
    return items.join(known, keys, "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))


def located(found: DataFrame, places: DataFrame, point: tuple[float, float]) -> DataFrame:
    """found (restaurant_id, …) with lat and lng of its places; a place that is missing, or has no coordinates, stands at the query's point."""
    at = places.select("restaurant_id", "lat", "lng")
    both = found.drop("lat", "lng").join(at, "restaurant_id", "left")
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return both.withColumns({c: F.when(known, F.col(c)).otherwise(F.lit(p)) for c, p in zip(("lat", "lng"), point)})


def cached_results(cache: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """requests (query, lat, lng, radius) with the stored results (key, results, expires_at) that still hold; null for the others.

    Order and limit are no part of the key. Of several stored results the one that holds longest counts.
    """
    valid = cache.where(F.col("expires_at") > as_of).groupBy("key").agg(F.max_by("results", "expires_at").alias("results"))
    keyed = requests.withColumn("key", tx.cache_key(F.col("query"), F.col("lat"), F.col("lng"), F.col("radius")))
    return keyed.join(valid, "key", "left")
