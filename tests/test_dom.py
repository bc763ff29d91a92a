import random

import duckdb
from pyspark.sql import functions as F

from tidewise.functions import dom
from tidewise.operators import extract as ex
from tidewise.queries import pages as pq


def flat(node):
    return [node.tag, node.attrs, [c if isinstance(c, str) else flat(c) for c in node.children]]


def counted(monkeypatch):
    """How many text pieces have been looked at."""
    seen, strings = [0], dom.Node.strings

    def count(self):
        for x in strings(self):
            seen[0] += 1
            yield x

    monkeypatch.setattr(dom.Node, "strings", count)
    return seen


def test_surroundings_of_images_are_read_once(monkeypatch):
    """the text around the images of a page was read again for every image."""
    page = "<div>our menu <p>" + "".join(f'<img src="/{i}.jpg" width="900" height="900">x' for i in range(2_000)) + "</p></div>"
    seen = counted(monkeypatch)
    found = ex.menu_images(page, "https://x.example/")
    assert len(found) == 2_000 and all(i["near"] for i in found) and seen[0] < 10_000
    assert [i["near"] for i in ex.menu_images("<div>" + "a" * 301 + "menu<img src=a width=1 height=1></div><p>MENU<img src=b width=1 height=1>", "https://x.example/")] == [False, True]


def test_cut_references_stay(spark):
    """a title that was cut inside a reference."""
    html = "<html><head><title>a &amp;&amp; b &amp</title></head><body><nav>x</nav><p>fish &amp; chips &copy; &quot;q&quot; & so &nope; AT&T</p></body></html>"
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    db = duckdb.connect()
    db.sql("create table pages (url varchar, html varchar)")
    db.execute("insert into pages values ('u', ?)", [html])
    want = db.sql(pq.CLEANED_SQL).fetchall()
    assert [tuple(r) for r in ex.page_texts(pages, only_ended=True).select("url", F.length("text").cast("long"), F.sha2("text", 256)).collect()] == want
    assert ex.clean_text(html).startswith("a && b &\n") and ex.clean_text("&#65;&#x42;&#67 &notit; &copy 1", True) == "AB&#67 &notit; &copy 1"


def test_plain_pages_do_without_the_standard_parser(monkeypatch):
    """pages of plain tags went through the slower standard parser."""
    monkeypatch.setattr(dom._Builder, "feed", None)
    item = '<div itemscope itemtype="https://schema.org/MenuItem"><i itemprop="name">Pie {0}</i><i itemprop="price">$1.50</i></div>'
    assert [i["name"] for i in ex.structured_data("<!DOCTYPE html>" + "".join(map(item.format, range(3))))] == ["Pie 0", "Pie 1", "Pie 2"]


def test_elements_around_are_read_once(monkeypatch):
    """the text of a list was read again for each of its items."""
    page = "<div>" + "".join(f"<div>Soup number {i} $5.00</div>" for i in range(1_000)) + "</div>"
    seen = counted(monkeypatch)
    assert len(ex.heuristic_items(page)) == 1_000 and seen[0] < 20_000


def test_trees_equal_the_standard_parser():
    rnd = random.Random(1)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<tr>", "<td>", "<table>", "text", "&amp;", "& ", " <", ">", "<br>", "<br/>", '<img src="a/b?x=1">', "<img src=/a/ >", "<a href='x y' TITLE=\"q>r\" >", '<A B C="d" b=e>', "<script>", "a<b</div>\"", "</script>", "<!-- x -->", "<!doctype html>", "<!DOCTYPE HTML PUBLIC 'x'>", "<?p?>", "</", "</ div>", "</div x>", "<h-1 a='b'c='d'>", "<title>", "\t<b\n a='1'\f>", "<i a='&lt;'>", "<", "&#65", "<!--", "<i a='1' a='2' A='3'>", "</P>", "<!--->", "<i a = 'b'>", "<i a=b/>", "\x00<i\x00 a='b'>", "<i a b/ >", "<!-->x-->"]
    for _ in range(3_000):
        html = "".join(rnd.choices(pieces, k=rnd.randrange(1, 12)))
        root = dom.Node("", {}, None)
        builder = dom._Builder(root, root)
        builder.feed(html)
        builder.close()
        assert flat(dom.parse(html)) == flat(root), html
