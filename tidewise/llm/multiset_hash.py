"""Operator 12: document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

1. A text is cut into paragraphs: a paragraph ends with a line or a sentence, or after MOST code points; together they are the text.
2. A paragraph's 256 hash bits (four seeds of xxhash64) are a vector of 256 numbers, 0 or 1. A text's fingerprint is the sum of the vectors of its paragraphs and their
   number, each modulo 2^16. Four numbers of 16 bits are packed in one long, so that one addition sums four of them.
3. Sums don't depend on the order of paragraphs, and paragraphs are inserted and deleted by adding and subtracting their vectors. Texts with the same paragraphs, as
   often, have the same fingerprint; others have it with a probability of some 2^-256.
4. Twice a sum less the number of paragraphs is a sum of random signs, so that the mean product of two such vectors estimates the paragraphs that two texts share, and the
   mean square difference those that they don't (a paragraph that a text has k times counts k^2). likeness is 1 - |a - b|^2 / (|a|^2 + |b|^2), with an error of about 0.06, and 1 for equal fingerprints only.

`fingerprint_edits` compares every document with an edited text and with the next document. An edit replaces the end of a text, so the fingerprint of the edited text is that of
the document less the paragraphs at its end plus the new ones; only the end is hashed again. The next document is the one with the next larger id (null ids come last, the
first id follows on the last); of several rows with that id it is the text with the smallest md5. Texts are shuffled once, the heads of the next ones (a quarter) once.

Null texts are empty: no paragraphs, all sums zero; likeness of two empty texts is 1, of an empty one and another 0. Repeated rows come out as often as they came in. An
empty table gives an empty result. Ids have any type with an order. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.shared import materialise, scratch

#: Code points of a paragraph without an end of a line or sentence.
MOST = 120
PARAGRAPH = rf"[^\n.!?]{{1,{MOST}}}[\n.!?]*|[\n.!?]+"
SEEDS, BITS, LANES = 4, 64, 4
#: Longs of a vector; each holds LANES sums of 16 bits.
WIDTH = SEEDS * BITS // LANES
#: Paragraphs summed before sums are brought below 2^16 again; no sum can reach the next one before.
TOGETHER = 32767
#: Hashes summed in 4 bits: the uppermost sum must not reach the sign.
FEW = 7
_ONES = 0x0001000100010001
_NIBBLES = 0x1111111111111111
_WIDE = 0x000F000F000F000F
_EVEN = 0x0000FFFF0000FFFF


def _add(x: Column, y: Column) -> Column:
    """Sums of the four packed numbers, each modulo 2^16."""
    low = ((x.bitwiseAND(_EVEN)) + (y.bitwiseAND(_EVEN))).bitwiseAND(_EVEN)
    high = F.shiftrightunsigned(x, 16).bitwiseAND(_EVEN) + F.shiftrightunsigned(y, 16).bitwiseAND(_EVEN)
    return low.bitwiseOR(F.shiftleft(high.bitwiseAND(_EVEN), 16))


def _negative(x: Column) -> Column:
    return _add(F.bitwise_not(x), F.lit(_ONES))


def add(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of both."""
    return F.zip_with(a, b, _add)


def subtract(a: Column, b: Column) -> Column:
    """The vector of a's paragraphs without those of b."""
    return F.zip_with(a, b, lambda x, y: _add(x, _negative(y)))


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def vector(paras: Column) -> Column:
    """WIDTH longs of four sums, and the number of paragraphs modulo 2^16."""

    def total(values: Column, shift: int, mask: int) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, shift).bitwiseAND(mask))

    def bits(hashes: Column) -> Column:
        """Sums of the 64 bits over all hashes: first 16 sums of 4 bits in a long for every FEW hashes, then 4 sums of 16 bits in a long for all."""
        few = F.transform(F.sequence(F.lit(0), F.floor(F.size(hashes) / FEW).cast("int")), lambda k: F.slice(hashes, k * FEW + 1, FEW))
        narrow = lambda shift: F.transform(few, lambda h: total(h, shift, _NIBBLES))
        return F.concat(*[_step(narrow(shift), lambda n: F.array(*[total(n, 4 * k, _WIDE) for k in range(4)])) for shift in range(4)])

    def summed(part: Column) -> Column:
        seeded = lambda seed: F.transform(part, lambda p: F.xxhash64(F.lit(seed), p))
        return F.concat(*[_step(seeded(seed), bits) for seed in range(SEEDS)], F.array(F.size(part).cast("long")))

    def of(all_: Column) -> Column:
        last = F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / TOGETHER).cast("int")
        part = lambda p: F.slice(all_, p * TOGETHER + 1, TOGETHER)
        zero = F.array_repeat(F.lit(0).cast("long"), WIDTH + 1)
        return F.aggregate(F.sequence(F.lit(0), last), zero, lambda a, p: add(a, _step(part(p), summed)))

    return _step(paras, of)


def _step(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(vec: Column) -> Column:
    """A vector as text: 16 hexadecimal digits a long, and four of the number of paragraphs."""
    digits = F.transform(F.slice(vec, 1, WIDTH), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.array_join(digits, ""), F.lpad(F.hex(F.element_at(vec, -1).bitwiseAND(0xFFFF)), 4, "0")))


def _signs(vec: Column) -> Column:
    """Twice each sum less the number of paragraphs, as numbers from -2^15 to 2^15 - 1."""
    n = F.element_at(vec, -1)
    one = lambda x, k: F.shiftrightunsigned(x, 16 * k).bitwiseAND(0xFFFF)
    centred = lambda x: F.pmod(2 * x - n + 32768, F.lit(65536)) - 32768
    return F.flatten(F.transform(F.slice(vec, 1, WIDTH), lambda x: F.array(*[centred(one(x, k)) for k in range(LANES)])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two vectors; 1 if they are equal, 0 if one of them has no paragraphs."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)

    def of(pair: Column) -> Column:
        whole = square(pair["a"]) + square(pair["b"])
        apart = square(F.zip_with(pair["a"], pair["b"], lambda x, y: (x - y).cast("double")))
        return F.when(whole == 0, 0.0).otherwise(F.least(F.greatest(1 - apart / whole, F.lit(0.0)), F.lit(0.999999)))

    none = lambda v: F.forall(v, lambda x: x == 0)
    signs = F.struct(_signs(a).alias("a"), _signs(b).alias("b"))
    return F.when(a == b, 1.0).when(none(a) | none(b), 0.0).otherwise(_step(signs, of))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "vector") -> DataFrame:
    """docs with the vector of their texts, a column like those in it replaced."""
    return docs.withColumn(to, vector(paragraphs(F.coalesce(F.col(text), F.lit("")))))


def combined(vectors: DataFrame, by: list[str], vec: str = "vector") -> DataFrame:
    """(by, vector) of all paragraphs of each group of rows, e.g. of a source. Sums are additive, so a hot group is aggregated before the shuffle."""
    lanes = vectors.select(*by, F.posexplode(vec).alias("lane", "x"))
    sums = lanes.groupBy(*by, "lane").agg(*[F.sum(F.shiftrightunsigned("x", 16 * k).bitwiseAND(0xFFFF)).alias(f"s{k}") for k in range(LANES)])
    packed = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.col(f"s{k}").bitwiseAND(0xFFFF), 16 * k) for k in range(LANES)])
    lane = F.struct("lane", packed.alias("x"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(lane)), lambda v: v["x"]).alias(vec))


def chained(docs: DataFrame) -> DataFrame:
    """One row per different doc_id: doc_id, n (code points of its longest text), next_id."""
    ids = docs.groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    by_id = F.col("doc_id").asc_nulls_last()
    dealt = materialise(ids.repartitionByRange(by_id).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("range").orderBy(by_id)
    # one row a range
    firsts = dealt.withColumn("no", F.row_number().over(own)).where("no = 1").select("range", F.struct("doc_id").alias("first"))
    ranges = Window.orderBy("range")
    follow = firsts.select("range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges)).alias("follow"))
    near = dealt.withColumn("near", F.lead(F.struct("doc_id")).over(own)).join(follow, "range")
    return near.select("doc_id", "n", F.coalesce("near", "follow")["doc_id"].alias("next_id"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with scratch(docs.sparkSession) as keep:
        chain = keep(materialise(chained(rows)))
    chain = chain.select(F.col("doc_id").alias("before_id"), "n", "next_id")
    given = rows.alias("d").join(chain.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.next_id"))).select(
        "before_id", F.struct(F.md5("text").alias("no"), F.substring("text", F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("head"), vector(paragraphs(F.col("text"))).alias("vector")).alias("next")
    )
    given = given.groupBy("before_id").agg(F.min("next").alias("next"))
    both = rows.alias("d").join(given.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.before_id"))).withColumn("n_chars", F.length("text"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int")
    both = both.withColumns({"kept": F.substring("text", F.lit(1), kept), "new": F.substring("next.head", F.lit(1), F.col("n_chars") - kept)})
    # all paragraphs of the kept text but the last one are paragraphs of both texts
    both = both.withColumn("paras", paragraphs(F.col("kept")))
    last = F.when(F.size("paras") > 0, F.element_at("paras", -1)).otherwise("")
    same = F.slice("paras", 1, F.greatest(F.size("paras") - 1, F.lit(0)))
    old = F.substring("text", F.length("kept") - F.length(last) + 1, F.col("n_chars"))
    parts = {"same": vector(same), "old": vector(paragraphs(old)), "tail": vector(paragraphs(F.concat(last, "new")))}
    both = both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.concat("kept", "new"), 256).alias("edited_sha256"), F.col("next.vector").alias("next"), *[v.alias(c) for c, v in parts.items()])
    whole = both.withColumns({"vector": add(F.col("same"), F.col("old")), "edited": add(F.col("same"), F.col("tail"))})
    v, e = F.col("vector"), F.col("edited")
    return whole.select("doc_id", "n_chars", "edited_sha256", fingerprint(v).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"), likeness(v, e).alias("near_edited"), likeness(v, F.col("next")).alias("near_next"))


#: The columns without fingerprints.
BASE_SQL = """
with docs as (select doc_id, coalesce(text, '') as text from documents), following as (
  select doc_id, text, length(text) as n, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as after from docs
)
select doc_id, n as n_chars, sha256(left(text, n - n // 4) || left(after, n // 4)) as edited_sha256 from following
"""
