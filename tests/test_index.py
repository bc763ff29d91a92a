import random
import re

import pytest
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.operators import search as s
from tidewise.operators.index import MOST_PAIRED, SearchIndex, quadtree

POINT = (32.8755, -117.2295)
WORDS = ["hot", "plate", "plates", "spicy", "taco", "tacos", "mac", "macaroni", "cheese", "rib-eye", "ribeye", "café", "ring", "rings", "small", "über", "bbq", "barbecue", "x_y", "100%"]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(11)
    places = [(i, f"Place {i}", rnd.choice([None, 3.5, 4.5]), POINT[0] + rnd.uniform(-0.3, 0.3), POINT[1] + rnd.uniform(-0.3, 0.3)) for i in range(120)]
    places += [(500 + i, f"Dense {i}", 4.0, 32.9, -117.2) for i in range(120)]  # half of all places in one cell
    places += [(900, "Nowhere", None, None, None), (901, "No items", 1.0, POINT[0], POINT[1]), (902, "Far", 1.0, -32.0, 151.0)]
    items, no = [], 0
    for p in places:
        for _ in range(rnd.randrange(0, 25) if p[0] != 901 else 0):
            no += 1
            name = " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 5))).title()
            items.append((p[0], no, name, rnd.choice([None, "", "served " + rnd.choice(WORDS), "plain"]), float(rnd.randrange(1, 40)), rnd.choice([None, "Mains", "tacos"])))
    items += [(3, 10_001, " ".join(f"w{i}" for i in range(MOST_PAIRED + 20)) + " hot plate", None, 1.0, None), (3, 10_002, None, None, None, None)]
    return spark.createDataFrame(places, "restaurant_id long, name string, rating double, lat double, lng double"), spark.createDataFrame(items, "restaurant_id long, item_id long, name string, description string, price double, category string")


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions too large to be joined
    SearchIndex.build(*tables, folder=folder, cell_rows=120, region_rows=900)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return SearchIndex.read(spark, folder)


def rows(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


QUERIES = ["hot plate", "smal rng", "mac cheese", "rib-eye", "the", "x_y", "100%", "Über plates"]


@pytest.mark.parametrize("query", QUERIES)
def test_candidates_equal_the_scan(tables, index, query):
    want = s.candidates(*tables, query, POINT, 20_000, hit_cap=40)
    got = index.candidates(query, POINT, 20_000, hit_cap=40)
    columns = ("ord", "restaurant_id", "item_id", "name", "rank", "distance_m", "place", "price")
    assert rows(got, *columns) == rows(want, *columns)


@pytest.mark.parametrize(("query", "sort"), [("hot plate", "relevance"), ("tacos", "price_low"), ("pl", "distance")])
def test_searches_equal_the_scan(tables, index, query, sort):
    columns = ("position", "restaurant_id", "distance_miles", "matched_items", "total_results")
    assert rows(index.search(query, POINT, 20_000, sort), *columns) == rows(s.search(*tables, query, POINT, 20_000, sort), *columns)


def test_not_stemmed_and_groups(tables, index):
    for args in ({"stemmed": False}, {"groups": [["hot", "café"]]}, {"groups": ["hot x_y"]}):
        assert rows(index.candidates("hot plates", POINT, 20_000, **args), "item_id", "rank") == rows(s.candidates(*tables, "hot plates", POINT, 20_000, **args), "item_id", "rank")


@pytest.mark.parametrize("query", ["hot plate", "smal rng", "the", "100%"])
def test_autocomplete_equals_the_scan(tables, index, query):
    placed = tables[1].join(tables[0].where("lat is not null").select("restaurant_id"), "restaurant_id")
    assert rows(index.autocomplete(query, 30), "name", "sim") == rows(s.autocomplete(placed, query, 30), "name", "sim")


def test_statistics_equal_the_scan(tables, index):
    rnd = random.Random(5)
    for k in range(4):
        point, radius = (POINT[0] + rnd.uniform(-0.3, 0.3), POINT[1] + rnd.uniform(-0.3, 0.3)), rnd.choice([100, 5_000, 16_000, 60_000])
        words = rnd.sample(WORDS if k % 2 else ["hot", "plate", "tacos", "café", "ring"], 3)
        near = s.near(tables[0], point, radius).select("restaurant_id")
        want = s._statistics(tables[1].join(near, "restaurant_id"), words).first().asDict()
        assert index.statistics(words, point, radius).first().asDict() == want
        table = {r.word: (r.n, r.n_items) for r in index.word_table(point, radius).collect()}
        assert all(table.get(w, (0,))[0] == want[f"n_{i}"] for i, w in enumerate(words) if re.fullmatch(r"\w+", w))
        assert {n for _, n in table.values()} <= {want["n_items"]}
    assert index.cover(POINT, 60_000).inner and index.cover(POINT, 60_000).long


def test_near_equals_the_scan_and_prunes(tables, index):
    for point, radius in ((POINT, 5_000), (POINT, 100), ((-32.0, 151.0), 1_000), ((89.5, 0.0), 1_000), ((32.9, 179.99), 9_000)):
        assert rows(index.near(point, radius), "restaurant_id", "distance_m") == rows(s.near(tables[0], point, radius), "restaurant_id", "distance_m")
    used = {f for f in index.near(POINT, 3_000).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(used) < len(index.places.inputFiles()) / 2
    plan = index.near(POINT, 3_000)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_postings_prune_by_term(index):
    found = index.text_ranks("plates")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan) and "lexemes" in plan and "description" not in plan
    assert found.count() > 0


def test_a_dense_cell_is_dealt_to_files(index):
    cells = index.cells.collect()
    assert max(c.n_items for c in cells) > 120 and len(cells) > 10  # one place of many, beyond any split
    dense = max(cells, key=lambda c: c.n_items)
    files = index.items.where(F.col("cell") == dense.cell).select(F.input_file_name()).distinct().count()
    assert files > 1 and sum(c.n_items for c in cells) == index.items.count() and sum(c.n_places for c in cells) == index.places.count()


def test_quadtree_against_counting(spark):
    rnd = random.Random(3)
    points = [(rnd.randrange(1 << 20) if i % 3 else 777, rnd.randrange(1 << 20) if i % 3 else 555, rnd.randrange(1, 4)) for i in range(400)]
    tree = quadtree(spark.createDataFrame(points, "x int, y int, n int"), "n", cell=20, region=100).collect()
    inside = lambda level, cx, cy: sum(n for x, y, n in points if x >> 20 - level == cx and y >> 20 - level == cy)
    assert {(r.x, r.y) for r in tree} == {(x, y) for x, y, _ in points}
    for r in tree:
        for c, most in ((r.cell, 20), (r.region, 100)):
            level = next(k for k in range(21) if inside(k, r.x >> 20 - k, r.y >> 20 - k) <= most or k == 20)
            assert (c.level, c.cx, c.cy, c.n) == (level, r.x >> 20 - level, r.y >> 20 - level, inside(level, r.x >> 20 - level, r.y >> 20 - level))


def test_empty_tables(spark, tables, tmp_path):
    index = SearchIndex.build(tables[0].limit(0), tables[1].limit(0), folder=str(tmp_path / "i"))
    assert index.search("hot plate", POINT).collect() == [] and index.autocomplete("hot").collect() == []
    assert index.statistics(["hot"], POINT).first().asDict() == {"n_items": 0, "n_0": 0} and index.word_table(POINT).collect() == []


def test_nearby_pairs_with_a_dense_cell(spark, tables):
    places = tables[0].select("restaurant_id", "lat", "lng")
    points = places.where("restaurant_id % 7 = 0 and lat is not null").withColumnRenamed("restaurant_id", "point_id")
    want = points.alias("p").crossJoin(places.alias("q")).select("point_id", "restaurant_id", geo.distance_m(F.col("p.lat"), F.col("p.lng"), F.col("q.lat"), F.col("q.lng")).alias("d")).where("d <= 4000")
    got = geo.nearby_pairs(points, places, 4000.0, most=10)
    assert rows(got, "point_id", "place_restaurant_id") == rows(want, "point_id", "restaurant_id")


def test_parts_are_not_broadcast_and_lines_are_dealt_once(spark):
    """F5, F7, F8, F10 to F13: parts of a small file were broadcast, as rows of many times its size; lines were dealt by pair, then by part."""
    from tidewise.sources.bridge import menu_items

    plan = menu_items(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan and len(re.findall(r"Exchange hashpartitioning\(l_", plan)) == 1


def test_items_are_made_once(spark, tables, tmp_path):
    """The rows of items were made again for places, texts and items; here every row that is made counts."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    items = tables[1].mapInArrow(count, tables[1].schema)
    SearchIndex.build(tables[0], items, folder=str(tmp_path / "i"))
    assert made.value == tables[1].count()
