"""A stored index of places and items, made once a table, of which a search near a point reads what it needs.

* Cells: a quadtree over latitude and longitude, split until a cell has at most `cell_rows` items (or is some 40 metres wide). Places and items lie in a folder per cell, so
  that a radius prunes files; a cell that stays denser than that is dealt to several files. Regions are cells of the same tree with at most `region_rows` items.
* Texts: every different (name, description, category) of a region once, with its lexemes. Items name their text by a 128-bit id.
* Postings: (kind, term) -> texts, in folders by hash of the term, sorted by term and region. Kinds are lexemes of all fields (with positions, weights and the best weight), words of the
  name, and trigrams of the name and of the description (with the number of trigrams there). A text that matches a query is found by its lexemes, by a word, by as many common
  trigrams as the least similarity needs, or by the trigrams inside the query's words, if it contains the query; what is found is then scored exactly.
* Counts: for each cell how many items have a word in their name, and how many have both words of a pair. Cells inside a radius are added up, and only those on its
  border are read item by item.

Rows without coordinates are not indexed. Places and items have the columns of `search`; others of items pass through to its hits, others of places stay in `places`.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.functions import text as tx
from tidewise.functions.fulltext import indexed, query_terms, text_rank
from tidewise.functions.synonyms import expand
from tidewise.operators import search as s
from tidewise.sources.shared import materialise, scratch, shared_dir

DEPTH = 20
TEXT = ["name", "description", "category"]
#: Kinds of terms.
LEXEME, WORD, NAME, DESCRIPTION = "l", "w", "n", "d"
BUCKETS = 64
#: Names of more words have no stored pairs; they are read where pairs are asked for.
MOST_PAIRED = 32
_OWN = ("x", "y", "cell", "region", "n_items", "text_id")


def text_key() -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*TEXT))))


def _bucket(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")


def name_words(name: Column) -> Column:
    """The different words of a name as `whole_word` sees them, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def _is_word(word: str) -> bool:
    return re.fullmatch(r"\w+", word) is not None


def inner_trigrams(query: str) -> list[str]:
    """Trigrams of every text that contains the query (% and _ stand for anything): those inside its words."""
    return sorted({w[i : i + 3] for w in re.findall(r"[^\W_]+", query.lower()) for i in range(len(w) - 2)})


def quadtree(points: DataFrame, rows: str, **most: int) -> DataFrame:
    """(x, y) of points (x, y on the grid of DEPTH, rows) with a struct (id, level, cx, cy, n) for each limit: the largest cell around it with at most that many rows.

    A cell of the last level has as many as there are. Points at one place are counted first, so that a dense place is one row.
    """
    own = points.groupBy("x", "y").agg(F.sum(rows).alias("n"))
    above = own.select("x", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"))
    above = above.withColumns({c: F.expr(f"shiftright({p}, {DEPTH} - level)") for c, p in (("cx", "x"), ("cy", "y"))})
    counted = above.groupBy("level", "cx", "cy").agg(F.sum("n").alias("in_cell"))
    cell = F.struct("level", "cx", "cy", F.col("in_cell").alias("n"))
    least = lambda limit: F.min(F.when((F.col("in_cell") <= limit) | (F.col("level") == DEPTH), cell))
    found = above.join(counted, ["level", "cx", "cy"]).groupBy("x", "y").agg(*[least(limit).alias(name) for name, limit in most.items()])
    named = lambda c: F.struct(F.concat_ws("_", f"{c}.level", f"{c}.cx", f"{c}.cy").alias("id"), f"{c}.*")
    return found.select("x", "y", *[named(name).alias(name) for name in most])


def on_grid(lat: Column, lng: Column) -> dict[str, Column]:
    place = lambda c, low, span: F.least(F.greatest(F.floor((c - low) / span * (1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("int")
    return {"x": place(lng, -180.0, 360.0), "y": place(lat, -90.0, 180.0)}


@dataclass
class Cover:
    """Ids of the cells that a radius touches: those wholly inside, those on its border, and their regions; those inside with long names."""

    inner: list[str]
    border: list[str]
    regions: list[str]
    long: list[str]

    def holds(self, cells: list[str] | None = None) -> Column:
        return F.col("cell").isin(self.inner + self.border if cells is None else cells)


@dataclass
class SearchIndex:
    cells: DataFrame
    places: DataFrame
    items: DataFrame
    texts: DataFrame
    postings: DataFrame
    counts: DataFrame

    # --- places ---

    def cover(self, point: tuple[float, float], radius_m: float) -> Cover:
        """One row per cell that the radius touches comes to the driver."""
        width = lambda span: F.lit(span) / F.pow(F.lit(2.0), F.col("level"))
        box = {"south": -90.0 + F.col("cy") * width(180.0), "north": -90.0 + (F.col("cy") + 1) * width(180.0), "west": -180.0 + F.col("cx") * width(360.0), "east": -180.0 + (F.col("cx") + 1) * width(360.0)}
        d_lat, d_lng = geo.reach(point, radius_m)
        near = (F.col("north") >= point[0] - d_lat) & (F.col("south") <= point[0] + d_lat)
        if d_lng is not None:
            near = near & (F.col("east") >= point[1] - d_lng) & (F.col("west") <= point[1] + d_lng)
        corner = lambda lat, lng: geo.distance_m(F.col(lat), F.col(lng), F.lit(float(point[0])), F.lit(float(point[1]))) < radius_m * 0.9999
        inner = reduce(lambda a, b: a & b, [corner(lat, lng) for lat in ("south", "north") for lng in ("west", "east")], F.col("level") >= 6)
        rows = self.cells.withColumns(box).where(near).select("cell", "region", "n_long", inner.alias("inner")).collect()
        return Cover([r.cell for r in rows if r.inner], [r.cell for r in rows if not r.inner], sorted({r.region for r in rows}), [r.cell for r in rows if r.inner and r.n_long])

    def near(self, point: tuple[float, float], radius_m: float, cover: Cover | None = None) -> DataFrame:
        """Places within the radius with distance_m, from the files of the cells that it touches."""
        cover = cover or self.cover(point, radius_m)
        return s.near(self.places.where(cover.holds()), point, radius_m)

    # --- matches ---

    def matching(self, query: str, regions: list[str] | None, groups: list[list[str] | str] | None = None, stemmed: bool = True) -> DataFrame | None:
        """(region, text_id) of all texts that can match, from the postings of the query's terms; None if terms cannot tell."""
        stems, grams, inner = query_terms(query), tx.trigrams_of(query), inner_trigrams(query)
        forms = {w for own in expand(tx.query_tokens(query), groups).values() for w in own}
        if not inner or not stemmed or not all(re.search(r"\w", w) for w in forms):
            return None
        first = sorted({re.search(r"\w+", w)[0] for w in forms})
        wanted = {LEXEME: stems, WORD: first, NAME: sorted({*grams, *inner}), DESCRIPTION: grams}
        terms = [(k, t) for k, own in wanted.items() for t in own]
        is_one = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("term").isin(own) for k, own in wanted.items() if own])
        found = self.postings.where(_in_buckets(terms) & is_one)
        if regions is not None:
            found = found.where(F.col("region").isin(regions))
        has = lambda kind, own: F.count_if((F.col("kind") == kind) & F.col("term").isin(own))
        size = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("size")))
        sums = {"full": has(LEXEME, stems or [""]), "word": has(WORD, first or [""]), "inside": has(NAME, inner)}
        sums |= {f"n_{k}": has(k, grams) for k in (NAME, DESCRIPTION)} | {f"size_{k}": size(k) for k in (NAME, DESCRIPTION)}
        of_text = found.groupBy("region", "text_id").agg(*[c.alias(name) for name, c in sums.items()])
        alike = lambda k: F.col(f"n_{k}") > (s.SIMILAR - 1e-9) * (F.col(f"size_{k}") + len(grams) - F.col(f"n_{k}"))
        match = (F.col("word") > 0) | (F.col("inside") == len(inner)) | F.coalesce(alike(NAME), F.lit(False)) | F.coalesce(alike(DESCRIPTION), F.lit(False))
        if stems:
            match = match | (F.col("full") == len(stems))
        return of_text.where(match).select("region", "text_id")

    def _texts(self, query: str, regions: list[str] | None, groups=None, stemmed: bool = True) -> DataFrame:
        texts = self.texts if regions is None else self.texts.where(F.col("region").isin(regions))
        found = self.matching(query, regions, groups, stemmed)
        return texts if found is None else texts.join(found, ["region", "text_id"])

    def candidates(self, query: str, point: tuple[float, float], radius_m: float, groups=None, hit_cap: int = 5000, stemmed: bool = True, cover: Cover | None = None) -> DataFrame:
        """As search.candidates, from the index."""
        cover = cover or self.cover(point, radius_m)
        first, rank, match = s.score(query, groups, stemmed)
        scored = self._texts(query, cover.regions, groups, stemmed).withColumns(first).where(match).select("region", "text_id", *TEXT, rank.alias("rank"))
        places = self.near(point, radius_m, cover).withColumnRenamed("name", "place").drop("cell", "region")
        local = self.items.where(cover.holds()).drop("cell")
        return s.best_hits(local.join(scored, ["region", "text_id"]).drop("region", "text_id").join(places, "restaurant_id"), hit_cap)

    def text_ranks(self, query: str) -> DataFrame:
        """(region, text_id, rank) of the texts with all the query's stems, from the positions and weights of their postings alone."""
        stems = query_terms(query)
        own = self.postings.where(_in_buckets([(LEXEME, t) for t in stems]) & (F.col("kind") == LEXEME) & F.col("term").isin(stems or [""]))
        gathered = own.groupBy("region", "text_id").agg(F.array_sort(F.flatten(F.collect_list("lexemes"))).alias("lexemes"))
        return gathered.withColumn("rank", text_rank(F.col("lexemes"), query)).where("rank is not null").select("region", "text_id", "rank")

    def autocomplete(self, query: str, n: int = 10) -> DataFrame:
        """As search.autocomplete, over the names whose postings can match."""
        texts = self._texts(query, None) if query_terms(query) else self.texts
        return s.autocomplete(texts, query, n)

    # --- counts ---

    def statistics(self, words: list[str], point: tuple[float, float], radius_m: float = s.STATISTICS_M) -> DataFrame:
        """As search.word_statistics: counts of the cells inside, and the items of the cells on the border."""
        words = list(dict.fromkeys(words))
        cover = self.cover(point, radius_m)
        if not all(_is_word(w) for w in words):
            cover = Cover([], cover.inner + cover.border, cover.regions, [])
        ones = [(f"n_{i}", w, None) for i, w in enumerate(words)]
        pairs = [(f"n_{i}_{j}", *sorted((words[i], words[j]))) for i in range(len(words)) for j in range(i + 1, len(words))]
        inside = self.cells.where(F.col("cell").isin(cover.inner)).agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"))
        stored = self.counts.where(cover.holds(cover.inner) & _in_buckets([(w,) for w in words]) & F.col("word").isin(words))
        one = lambda a, b: F.coalesce(F.sum(F.when((F.col("word") == a) & F.col("other").eqNullSafe(F.lit(b)), F.col("n"))), F.lit(0))
        stored = stored.agg(*[one(a, b).alias(name) for name, a, b in ones + pairs])
        border = s._statistics(self._border(cover, point, radius_m), words, "n")
        columns = ["n_items", *[name for name, _, _ in ones + pairs]]
        zero = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(0)).cast("long").alias(c) for c in columns])
        whole = zero(inside).unionByName(zero(stored)).unionByName(zero(border))
        if pairs and cover.long:
            names = self.texts.where(F.col("region").isin(cover.regions) & (F.col("n_words") > MOST_PAIRED)).select("region", "text_id", "name")
            local = self.items.where(cover.holds(cover.long)).groupBy("region", "text_id").agg(F.count("*").alias("n")).join(names, ["region", "text_id"])
            whole = whole.unionByName(zero(s._statistics(local, words, "n").drop("n_items", *[name for name, _, _ in ones])))
        return whole.agg(*[F.sum(c).alias(c) for c in columns])

    def _border(self, cover: Cover, point: tuple[float, float], radius_m: float) -> DataFrame:
        """Names of the items of places within the radius in the cells on its border, with the number n of such items; every different text is read once."""
        places = s.near(self.places.where(cover.holds(cover.border)), point, radius_m).select("restaurant_id")
        local = self.items.where(cover.holds(cover.border)).select("restaurant_id", "region", "text_id").join(places, "restaurant_id")
        local = local.groupBy("region", "text_id").agg(F.count("*").alias("n"))
        return local.join(self.texts.where(F.col("region").isin(cover.regions)).select("region", "text_id", "name"), ["region", "text_id"])

    def word_table(self, point: tuple[float, float], radius_m: float = s.STATISTICS_M) -> DataFrame:
        """(word, n, n_items): items within the radius that have each word in their name, and all of them."""
        cover = self.cover(point, radius_m)
        border = self._border(cover, point, radius_m)
        of_border = border.select(F.explode(name_words(F.col("name"))).alias("word"), "n")
        words = self.counts.where(cover.holds(cover.inner) & F.col("other").isNull()).select("word", "n").unionByName(of_border).groupBy("word").agg(F.sum("n").alias("n"))
        inside = self.cells.where(F.col("cell").isin(cover.inner)).select(F.col("n_items").alias("n"))
        total = inside.unionByName(border.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)))
        return words.withColumn("n_items", total.scalar())

    # --- searches ---

    def search(self, query: str, point: tuple[float, float], radius_m: float = 5000.0, sort: str = "relevance", limit: int = 20, groups=None, hit_cap: int = 5000, stemmed: bool = True) -> DataFrame:
        """As search.search, from the index."""
        s.check_arguments(query, point, radius_m, sort, limit)
        words = tx.query_tokens(query)
        with scratch(self.items.sparkSession) as keep:
            hits = keep(materialise(self.candidates(query, point, radius_m, groups, hit_cap, stemmed)))  # hit_cap rows, read several times
        if sort == "relevance" and words:
            stats = self.statistics(words, point).first().asDict()
            hits = s.item_scores(hits, words, *s.rarity(stats, words), groups=groups)
        return s.rank_places(hits, len(words), sort).where(F.col("position") <= limit)

    # --- files ---

    @staticmethod
    def read(spark: SparkSession, folder: str) -> SearchIndex:
        """The index that build has written there."""
        schema = lambda name: spark.read.parquet(f"{folder}/{name}.columns").schema
        return SearchIndex(*[spark.read.schema(schema(f.name)).parquet(f"{folder}/{f.name}") for f in fields(SearchIndex)])

    @staticmethod
    def build(places: DataFrame, items: DataFrame, folder: str | None = None, cell_rows: int = 1 << 16, region_rows: int = 1 << 22) -> SearchIndex:
        """Writes the index of places (restaurant_id, name, lat, lng, …) and items (restaurant_id, item_id, name, description, category, …) and reads it."""
        spark = places.sparkSession
        folder = folder or f"{shared_dir(spark)}/tidewise/index-{uuid.uuid4().hex}"

        def put(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
            out = df.write.partitionBy(by) if by else df.write
            out.parquet(f"{folder}/{name}")
            df.limit(0).write.parquet(f"{folder}/{name}.columns")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        places = places.drop(*_OWN)
        columns = [c for c in items.columns if c not in _OWN]
        with scratch(spark):
            items = materialise(items.select(*columns).withColumn("text_id", text_key()))  # read for places, texts and items
            # so many words need twice the characters
            n_long = F.count_if((F.length(F.lower("name")) > 2 * MOST_PAIRED) & (F.size(name_words(F.col("name"))) > MOST_PAIRED))
            per_place = items.groupBy("restaurant_id").agg(F.count("*").alias("n_items"), n_long.alias("n_long"))
            placed = places.where("lat is not null and lng is not null").join(per_place, "restaurant_id", "left")
            placed = materialise(placed.withColumns(on_grid(F.col("lat"), F.col("lng")) | {c: F.coalesce(c, F.lit(0)) for c in ("n_items", "n_long")}))
            tree = materialise(quadtree(placed.withColumn("rows", F.col("n_items") + 1), "rows", cell=cell_rows, region=region_rows))
            of_place = placed.join(tree, ["x", "y"])
            by_cell = [F.col("cell.id").alias("cell"), F.col("region.id").alias("region"), "cell.level", "cell.cx", "cell.cy"]
            cells = put(of_place.groupBy(*by_cell).agg(F.sum("n_items").alias("n_items"), F.sum("n_long").alias("n_long"), F.count("*").alias("n_places")), "cells")
            # a cell that is denser than it should be goes to several files
            parts = F.ceil(F.col("cell.n") / cell_rows).alias("parts")
            own = materialise(of_place.select(*places.columns, F.col("region.id").alias("region"), F.col("cell.id").alias("cell"), parts))
            dealt = lambda df, *by: df.repartition("cell", F.pmod(F.xxhash64(*by), "parts")).drop("parts")
            stored = put(dealt(own, "restaurant_id"), "places", "cell")

            listed = items.join(own.select("restaurant_id", "region", "cell", "parts"), "restaurant_id")
            different = materialise(listed.select("region", "text_id", *TEXT).distinct())  # indexed reads them more than once
            texts = indexed(different).withColumn("n_words", F.size(name_words(F.col("name"))))
            texts = put(texts, "texts", "region")
            of_item = listed.select(*[c for c in columns if c not in TEXT], "text_id", "region", "cell", "parts")
            items_stored = put(dealt(of_item, "restaurant_id", "item_id"), "items", "cell")
            postings = put(_postings(texts), "postings", "bucket")
            counts = put(_counts(items_stored, texts), "counts", "bucket")
        return SearchIndex(cells, stored, items_stored, texts, postings, counts)


def _in_buckets(terms: list[tuple[str, ...]]) -> Column:
    """Whether a row is in a folder of one of the terms; known when the plan is made, so that other folders are never opened."""
    return F.col("bucket").isin([_bucket(*map(F.lit, t)) for t in terms]) if terms else F.lit(False)


def _postings(texts: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<struct<pos:int,weight:double,lexeme:string>>")

    def terms(kind: str, found: Column, size: Column, lexemes=lambda t: none) -> Column:
        return F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), size.cast("int").alias("size"), lexemes(t).alias("lexemes")))

    grams = {k: F.coalesce(tx.trigrams(F.col(c)), F.array().cast("array<string>")) for k, c in ((NAME, "name"), (DESCRIPTION, "description"))}
    rows = texts.select("region", "text_id", "lexemes", name_words(F.col("name")).alias("words"), *[g.alias(k) for k, g in grams.items()])
    stems = F.array_distinct(F.transform("lexemes", lambda x: x["lexeme"]))
    all_ = F.concat(
        terms(LEXEME, stems, F.size("lexemes"), lambda t: F.filter("lexemes", lambda x: x["lexeme"] == t)),
        terms(WORD, F.col("words"), F.size("words")),
        *[terms(k, F.col(k), F.size(k)) for k in grams],
    )
    found = rows.select("region", "text_id", F.explode(all_).alias("p")).select("region", "text_id", "p.*")
    found = found.withColumns({"best": F.array_max(F.transform("lexemes", lambda x: x["weight"])), "bucket": _bucket(F.col("kind"), F.col("term"))})
    return found.repartition("bucket").sortWithinPartitions("bucket", "kind", "term", "region")


def _counts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell, word, other, n): items whose name has the word, and those with both words (in order), by cell."""
    of_text = items.groupBy("cell", "region", "text_id").agg(F.count("*").alias("n"))
    words = texts.select("region", "text_id", F.array_sort(name_words(F.col("name"))).alias("words"))
    # each word alone, and with every later one
    later = lambda i: F.when(F.size("words") <= MOST_PAIRED, F.slice("words", i + 2, F.size("words"))).otherwise(F.array().cast("array<string>"))
    pairs = F.flatten(F.transform("words", lambda a, i: F.transform(F.concat(F.array(F.lit(None).cast("string")), later(i)), lambda b: F.struct(a.alias("word"), b.alias("other")))))
    rows = of_text.join(words, ["region", "text_id"]).select("cell", "n", F.explode(pairs).alias("p")).select("cell", "p.*", "n")
    counted = rows.groupBy("cell", "word", "other").agg(F.sum("n").alias("n")).withColumn("bucket", _bucket(F.col("word")))
    return counted.repartition("bucket").sortWithinPartitions("bucket", "word", "cell")
