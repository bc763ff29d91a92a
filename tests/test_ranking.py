"""Ranking against a plain Python statement of the rules, on the cases that the order has to meet."""

import math
import random

import pytest

from tidewise.functions import text as tx
from tidewise.functions.synonyms import DEFAULT_GROUPS, expand, group_words, synonym_map, synonym_table
from tidewise.operators.search import candidates, check_arguments, item_scores, rank_places

INF = float("inf")


def ranked(spark, places, words, idf, given=None, groups=()):
    """places: (name, miles, item names) -> [(name, tier, shown items, total)]."""
    rows, n = [], 0
    for i, (name, miles, items) in enumerate(places):
        for item in items:
            n += 1
            rows.append((i, name, miles, n, item, None, 10.0, None, n, None, None, None))
    hits = spark.createDataFrame(rows, "restaurant_id int, place string, distance_miles double, item_id int, name string, description string, price double, category string, ord int, rating double, lat double, lng double")
    scored = item_scores(hits, words, idf, given or {}, list(groups))
    got = rank_places(scored, len(words)).orderBy("position").collect()
    return [(r.place, r.tier, [x.name for x in r.matched_items], r.total_matched_items) for r in got]


def plain(places, words, idf, given=None):
    """The same, one place at a time."""
    given, out = given or {}, []
    has = lambda w, t: w in t.lower().split()
    for n, (name, miles, items) in enumerate(places):
        scores = []
        for k, item in enumerate(items):
            lit = {w for w in words if has(w, item)}
            eff = lit | {m for m in set(words) - lit if any(given.get(p, {}).get(m, 0) >= 0.7 for p in lit)}
            rel = sum(1.5 * idf[w] for w in words if has(w, item))
            scores.append((len(eff), sum(has(w, item) for w in words), rel, -k, item))
        scores.sort(reverse=True)
        best = scores[0]
        if not best[0]:
            continue
        kept = [s[4] for s in scores if s[0] == best[0]]
        far = miles if miles else INF
        tier = 1 if best[0] == len(words) and far <= 3 else 2
        value = best[2] + 0.3 * best[1] - 0.2 * (100 if miles is None else miles)
        key = (1, far, -best[1], -best[2], n) if tier == 1 else (2, -value, 0, 0, n)
        out.append((key, (name, tier, kept[:5], len(kept))))
    return [x for _, x in sorted(out, key=lambda x: x[0])]


W, IDF = ["mac", "cheese"], {"mac": 3.0, "cheese": 1.5}


@pytest.mark.parametrize(
    "places,given,order",
    [
        ([("Far", 5.0, ["Lobster Mac"]), ("Nearby", 1.0, ["Mac and Cheese"])], None, ["Nearby", "Far"]),
        ([("C", 2.5, ["Mac Cheese"]), ("A", 0.5, ["Mac Cheese"]), ("B", 1.5, ["Mac Cheese"])], None, ["A", "B", "C"]),
        ([("Pizza", 5.0, ["Cheese Pizza"]), ("Mac", 5.0, ["Lobster Mac"])], None, ["Mac", "Pizza"]),
        ([("Far", 8.0, ["Lobster Mac"]), ("Near", 4.0, ["Lobster Mac"])], None, ["Near", "Far"]),
        ([("A", 2.0, ["Mac Cheese"]), ("B", 8.0, ["Mac Cheese"]), ("C", 1.5, ["Lobster Mac"])], None, ["A", "B", "C"]),
        ([("Implied", 1.0, ["Lobster Mac"]), ("Perfect", 1.0, ["Mac Cheese"])], {"mac": {"cheese": 0.95}}, ["Perfect", "Implied"]),
        ([("Partial", 1.0, ["Lobster Mac"]), ("Perfect", 2.0, ["Mac Cheese"])], {"mac": {"cheese": 0.05}}, ["Perfect", "Partial"]),
    ],
)
def test_cases(spark, places, given, order):
    got = ranked(spark, places, W, IDF, given)
    assert [x[0] for x in got] == order and got == plain(places, W, IDF, given)


def test_random_places(spark):
    rnd = random.Random(1)
    words = ["mac", "cheese", "hot"]
    idf = {"mac": 3.0, "cheese": 1.5, "hot": 0.7}
    pool = ["mac", "cheese", "hot", "pizza", "bowl"]
    places = [(f"p{i}", rnd.choice([None, 0.0, 0.4, 1.0, 2.9, 3.0, 3.1, 7.5]), [" ".join(rnd.choices(pool, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 9))]) for i in range(60)]
    assert ranked(spark, places, words, idf, {"mac": {"cheese": 0.8}}) == plain(places, words, idf, {"mac": {"cheese": 0.8}})


def test_items_are_trimmed_but_counted(spark):
    (one,) = ranked(spark, [("A", 1.0, [f"Mac Cheese {i}" for i in range(10)])], W, IDF)
    assert len(one[2]) == 5 and one[3] == 10


def test_synonyms():
    known = synonym_map(["mac macaroni", "pie pizza", "pie tart"])
    assert known["mac"] == {"macaroni"} and known["pie"] == {"pizza", "tart"} and known["tart"] == {"pie"}
    assert all(a in known[b] for a in known for b in known[a])
    assert expand(["MAC", "x"], ["mac macaroni"]) == {"mac": {"mac", "macaroni"}, "x": {"x"}}


def test_whole_dictionary(spark):
    """The default has all groups, with phrases, and a search for "hot plate" finds items named picante."""
    known = synonym_map()
    assert len(DEFAULT_GROUPS) == 189 and all(len(set(group_words(g))) == len(group_words(g)) > 1 for g in DEFAULT_GROUPS)
    assert expand(["hot", "plate"]) == {"hot": {"hot", "spicy", "picante"}, "plate": {"plate"}}
    assert known["ribeye"] == {"rib-eye", "rib eye"} and known["sweet"] == {"dessert", "desserts", "postre", "dulce"} and known["gf"] == {"gluten free", "gluten-free", "glutenfree"}
    assert synonym_table(spark).where("word = 'hot dog'").count() == 1
    places = spark.createDataFrame([(1, "A", 4.0, 32.88, -117.23)], "restaurant_id long, name string, rating double, lat double, lng double")
    items = spark.createDataFrame([(1, 1, "Pollo Picante", "", 1.0, ""), (1, 2, "Rib Eye 8 oz", "", 1.0, ""), (1, 3, "Milk", "", 1.0, "")], "restaurant_id long, item_id long, name string, description string, price double, category string")
    found = lambda q: [r.item_id for r in candidates(places, items, q, (32.8755, -117.2295), 16_000).collect()]
    assert found("hot plate") == [1] and found("ribeye") == [2]


def test_tokens_and_arguments():
    assert tx.query_tokens("The mac and CHEESE, x") == ["mac", "cheese,"]
    for bad in (("", (0, 0), 500, "relevance", 5), ("q", (100, 0), 500, "relevance", 5), ("q", (0, 0), 50_000, "relevance", 5), ("q", (0, 0), 500, "name", 5), ("q", (0, 0), 500, "rating", 0)):
        with pytest.raises(ValueError):
            check_arguments(*bad)


def test_similarity(spark):
    df = spark.createDataFrame([("Hot Plate",), ("hot-plate!",), ("x",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.similarity(df.t, "hot plate")).collect()]
    assert got[0] == got[1] == 1.0 and got[2] == 0.0 and got[3] == 0.0 and got[4] is None


def test_whole_words(spark):
    df = spark.createDataFrame([("Macchiato",), ("mac & cheese",), ("JALAPEÑO poppers",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.whole_word(df.t, ["mac", "jalapeño"])).collect()] == [False, True, True, False]
    assert math.isclose(1, 1)
