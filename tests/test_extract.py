import math
import random
import re

from pyspark.sql import functions as F

from tidewise.functions import text as tx
from tidewise.functions.dom import parse
from tidewise.functions.fulltext import ENGLISH_STOP, indexed, stem, text_rank
from tidewise.operators import extract as ex
from tidewise.plans.cascade import scrape

LD = """<script type="application/ld+json">{"@type":"Restaurant","hasMenu":{"@type":"Menu","hasMenuSection":[{"@type":"MenuSection","name":"Desserts",
"hasMenuItem":[{"@type":"MenuItem","name":"Pie","offers":{"price":"12.99"}},{"@type":"MenuItem","name":"Cake","description":" good ","price":5},{"@type":"MenuItem","name":"Ice"}, {"name":null}, 3]}]}}</script>"""
PRICED = "<div><div class=i>Edamame $5.50</div><div class=i>Ramen Bowl $14</div><div class=i>Gyoza 7.25</div><div class=i>Gift card $50</div><div class=i>Mochi $4.00</div></div>"
TABLE = "<table>" + "".join(f"<tr><td>{n}</td><td>${p}</td></tr>" for n, p in [("Soup", "4.00"), ("Rice Plate", "9.50"), ("Tax", "1.00"), ("Noodles", "1,299.00"), ("Tea", "2.50"), ("Beans", "3")]) + "</table>"


def names(items):
    return [i["name"] for i in items or []]


def test_structured_data():
    items = ex.structured_data(LD)
    assert names(items) == ["Pie", "Cake", "Ice"] and items[0]["price"] == 12.99 and items[1]["description"] == "good" and {i["category"] for i in items} == {"dessert"}
    assert ex.structured_data(LD.replace('{"@type":"MenuItem","name":"Ice"},', "")) is None
    micro = "".join(f'<div itemtype="http://schema.org/MenuItem"><b itemprop="name">N{i}</b><i itemprop="price">$1,0{i}.50</i></div>' for i in range(3))
    assert [i["price"] for i in ex.structured_data(micro)] == [100.5 + 0, 101.5, 102.5] or [i["price"] for i in ex.structured_data(micro)] == [1000.5, 1001.5, 1002.5]


def test_heuristics():
    assert names(ex.heuristic_items(PRICED)) == ["Edamame", "Ramen Bowl", "Gyoza", "Mochi"]
    assert ex.heuristic_items("<div>A $5</div><div>B $6</div>") is None and ex.heuristic_items("<p>no prices</p>") is None
    assert {"Soup", "Rice Plate", "Tea", "Beans"} <= set(names(ex.heuristic_items(TABLE))) and "Tax" not in names(ex.heuristic_items(TABLE))


def test_platform_and_pattern():
    toast = "".join(f'<div class="menuItemContainer x"><h3 class=itemHeader>I{i}</h3><span class=price>$1,29</span><p class=itemDescription>A long description {i}</p></div>' for i in range(3))
    items = ex.platform_items(toast, "toast")
    assert names(items) == ["I0", "I1", "I2"] and items[0]["price"] == 1.29 and items[0]["description"] == "A long description 0"
    assert ex.platform_items(toast, "wix") is None and ex.platform_items(toast, "custom") is None
    learned = {"item_container": "div.menuItemContainer", "item_name": "h3"}
    assert [(i["name"], i["price"]) for i in ex.pattern_items(toast, learned)] == [("I0", 129.0), ("I1", 129.0), ("I2", 129.0)]
    assert ex.pattern_items(toast, {"item_name": "h3"}) is None


def test_every_page_is_read(spark):
    """Learned selectors find items on pages without digits or words of menus; a page without items has no row."""
    page = '<div class="dish"><b>Soup</b></div><div class="dish"><b>Bread</b></div><div class="dish"><b>Tea</b></div>'
    patterns = spark.createDataFrame([("custom", {"item_container": ".dish", "item_name": "b"})], "platform_type string, selectors map<string,string>")
    pages = spark.createDataFrame([("u", page, "custom"), ("v", "<p>x</p>", "custom"), ("w", None, None)], "url string, html string, platform_type string")
    assert [(r.url, r.method, r.name) for r in ex.extract_free(pages, patterns).orderBy("ord").collect()] == [("u", "pattern", n) for n in ("Soup", "Bread", "Tea")]


def test_titles_and_descriptions():
    """Joined descriptions, leaders, elements around an item, and texts beside it."""
    html = """<ul><li><div>Pad Thai ..... $12.50</div><p>rice noodles and peanuts</p></li><li>EdamameSpicy soy beans $5.00</li><li>Combo box 5pcs Sushi $15.00</li>
    <li><span>Tofu Bowl $9.00</span></li><li>$7.00</li><li>Reservation $20.00</li></ul><p>Tea $3.00</p><p>served hot or cold</p>"""
    items = {i["name"]: (i["description"], i["price"]) for i in ex.heuristic_items(html)}
    assert items["Edamame"] == ("Spicy soy beans", 5.0) and items["Combo box"][1] == 15.0 and items["Tea"] == ("served hot or cold", 3.0)
    assert "Reservation" not in items and not any(n.startswith("$") for n in items)


def test_selectors():
    root = parse("<ul><li class='a b' data-x=v1>one<li>two <b>three</b></ul><p>four<p>five")
    assert [n.text() for n in root.select("li")] == ["one", "twothree"] and [n.text() for n in root.select("p")] == ["four", "five"]
    assert root.first(".a.b").text() == "one" and root.first("[data-x*='1']").text() == "one" and root.first("ul b").text() == "three" and len(root.select("b, p")) == 3
    assert root.first("[data-x='v']") is None and root.select("p b") == []


def test_links(spark):
    html = """<a href="/menu">Menu</a><a href="https://order.toasttab.com/x">go</a><a href="https://other.com/">x</a><a href="https://else.com/m">our menu</a>
    <a href="#menu">menu</a><a href="/">home</a><a href="/docs/list.pdf">list</a><script>{"u":"/dinner-menu"}</script>"""
    got = ex.page_links(spark.createDataFrame([("https://me.com/", html)], "url string, html string")).collect()
    assert {r.link: r.score for r in got} == {"https://me.com/menu": 45, "https://else.com/m": 30, "https://me.com/docs/list.pdf": 15, "https://me.com/dinner-menu": 15, "https://order.toasttab.com/x": 8}
    assert [r.place for r in got] == [1, 2, 3, 4, 5]


def test_images(spark):
    html = '<div>our menu <img src="/a/menu-1.png?x=1" width=800 height=1200><img src="/logo.png" width=900 height=900><img data-src="/food.jpg" data-image-dimensions="2000x900"><img src="s.png"></div>'
    found = ex.page_images(spark.createDataFrame([("https://x.com/menu", html)], "url string, html string"))
    assert [(r.filename, r.near) for r in found.collect()] == [("menu-1.png?x=1", True), ("food.jpg", True)]
    assert [(r.image_url, r.score) for r in ex.best_images(found).collect()] == [("https://x.com/a/menu-1.png?x=1", 65)]


def test_lines(spark):
    text = "TACOS\nCarne Asada ..... $4.50\nwith onion and cilantro\nCARNITAS 5.25\nSales tax 1.00\nCarne asada 9.00\nab\nPOSTRES\n1. Flan - 6.00\nToo dear 900.00"
    rows = ex.parse_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r.name, r.description, r.price, r.category) for r in rows] == [("Carne Asada", "with onion and cilantro", 4.5, "taco"), ("CARNITAS", None, 5.25, "taco"), ("Flan", None, 6.0, "dessert")] or [r.name for r in rows] == ["Carne Asada", "CARNITAS", "Flan"]


def test_columns(spark):
    one = spark.createDataFrame([(x,) for x in ["EdamameSpicy soy beans", "Combo box 5pcs Sushi", "Plain name", "Lunch $ 1,299.00 ..."]], "x string")
    title, rest = tx.split_name(one.x)
    assert [tuple(r) for r in one.select(title, rest).collect()][:3] == [("Edamame", "Spicy soy beans"), ("Combo box", "5pcs Sushi"), ("Plain name", None)]
    assert [r[0] for r in one.select(tx.price_single(one.x)).collect()] == [None, None, None, 1299.0]
    assert one.select(tx.name_from_text(one.x)).collect()[3][0] == "Lunch"
    shell = spark.createDataFrame([("<script>x</script><p>hi</p>", "<p>" + "r" * 600 + "</p>", None), (None, None, "old")], "h string, r string, a string")
    assert [r[0][:4] for r in shell.select(ex.page_html(shell.h, shell.r, shell.a)).collect()] == ["<p>r", "old"]
    fenced = spark.createDataFrame([("u", '```json\n[{"name":"A","price":"3.5"},{"name":""},{"name":"B","price":"x"}]\n```')], "url string, answer string")
    assert [(r.name, r.price) for r in ex.model_items(fenced).collect()] == [("A", 3.5), ("B", None)]


def test_cascade(spark):
    page = lambda url, html: (url, html + "<p>" + "long text " * 80 + "</p>", None, None)
    sites = ["https://a.com", "https://b.com", "https://c.com", "https://d.com", "https://e.com"]
    pages = [
        page(sites[0], LD), page(sites[1], '<a href="/menu.pdf">x</a>'), page(sites[2], '<a href="/food">food</a>'), page("https://c.com/food", PRICED),
        page(sites[3], '<a href="/menu">menu</a>'), page("https://d.com/menu", '<a href="/menu/dinner">dinner</a>'), page("https://d.com/menu/dinner", TABLE),
    ]
    texts = [("https://b.com/menu.pdf", "Soup of the day 4.00\nRice with beans 5.00\nNoodles in broth 6.50\n" + "-" * 50)]
    outcomes, items = scrape(
        spark.createDataFrame([(s,) for s in sites], "site string"),
        spark.createDataFrame(pages, "url string, html string, rendered_html string, archived_html string"),
        spark.createDataFrame(texts, "url string, text string"),
    )
    got = {r.site: (r.method, r.n_items, r.failure) for r in outcomes.collect()}
    assert {s[8]: got[s][0] for s in sites} == {"a": "structured_data", "b": "pdf", "c": "heuristic", "d": "heuristic", "e": "none"}
    assert got[sites[4]][2] == "bot_blocked" and got[sites[1]][1] == 3 and items.where("site = 'https://c.com'").count() == 4


def test_stems_and_rank():
    pairs = {"running": "run", "tacos": "taco", "fries": "fri", "hopping": "hop", "hoped": "hope", "relational": "relat", "happily": "happili", "generously": "generous", "flies": "fli", "cheese": "chees", "national": "nation", "skies": "sky"}
    assert {w: stem(w) for w in pairs} == pairs


def slow_lexemes(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [(stem(w), i) for i, w in enumerate(words, 1) if w not in ENGLISH_STOP]


def slow_rank(fields, query):
    """Text rank of one row, pair by pair."""
    terms = list(dict.fromkeys(s for s, _ in slow_lexemes(query)))
    places, offset = {t: [] for t in terms}, 0
    for text, weight in zip(fields, (1.0, 0.4, 0.2), strict=True):
        found = slow_lexemes(text)
        for s, i in found:
            places.setdefault(s, []).append((i + offset, weight))
        offset += found[-1][1] if found else 0
    if not terms or not all(places[t] for t in terms):
        return None
    if len(terms) == 1:
        w = [x for _, x in places[terms[0]]]
        best = w.index(max(w))
        return (w[best] + sum(x / (k + 1) ** 2 for k, x in enumerate(w)) - w[best] / (best + 1) ** 2) / 1.64493406685
    left = 1.0
    for a in range(len(terms)):
        for b in range(a + 1, len(terms)):
            for i, u in places[terms[a]]:
                for j, v in places[terms[b]]:
                    d = abs(i - j) or 1
                    left *= 1 - math.sqrt(u * v * (1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30))
    return 1 - left


def test_text_rank_equals_brute_force(spark):
    rnd = random.Random(2)
    words = "taco tacos the fish fishes of hot plates plate running run and 7 x".split()
    text = lambda: rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randrange(12)))])
    rows = [(i, text(), text(), text()) for i in range(200)] + [(900, "Tacos", None, None), (901, "mac cheese", None, None)]
    rows += [(902, "fish " + "x " * 120 + "plate", None, None)]
    df = indexed(spark.createDataFrame(rows, "id long, name string, description string, category string"))
    for query in ("taco", "the", "", "fish plate", "hot running tacos", "mac and cheese", "unknown word"):
        got = {r[0]: r[1] for r in df.select("id", text_rank(df.lexemes, query)).collect()}
        assert len(got) == len(rows)
        for i, *fields in rows:
            want = slow_rank(fields, query)
            assert got[i] is None if want is None else abs(got[i] - want) < 1e-6, (query, fields)
    assert abs(slow_rank(("Tacos", None, None), "taco") - 0.6079) < 1e-4


def test_stemmed_search(spark):
    from tidewise.operators.search import score

    df = indexed(spark.createDataFrame([("Fish Tacos", None, None), ("Soup", "with taco shells", None), ("Stew", None, None)], "name string, description string, category string"))
    first, value, match = score("taco")
    got = {r.name: (round(r[1], 3), r[2]) for r in df.withColumns(first).select("name", value, match).collect()}
    assert got["Fish Tacos"] == (10.608, True) and got["Soup"] == (10.243, True) and not got["Stew"][1]
