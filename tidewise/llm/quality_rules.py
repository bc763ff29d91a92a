"""Operator 9: quality rules with cross-document line frequency, with DataFrame functions only.

Base rules look at one text: words, their characters, symbols, lines that repeat an earlier line, and words inside three-word
windows that occur twice or more. Texts that pass are judged by their lines: a line is normalised (lower case, numbers as 0,
white space around it gone) and the distinct documents of its host that hold it are counted; a document is an id with a text, so
a repeated row counts once and copies under other ids each count. Lines in more than max(`least`, min(`most`, `share` of the
host's documents)) documents are removed. A document is depleted, and rejected, if it loses more than `depleted` of its words or
if fewer than `enough` words are left.

Windows are found within a row: as many bits of the window's hash as its place leaves free make one number with it, so that
after one sort of numbers equal windows stand side by side; their words are then compared. A text where different windows share
those bits is sorted by the words themselves, so the count is exact at every length. A row needs memory in proportion to its text.

Lines and texts are told apart by 128 bits of their md5. Lines are summed up by text before they are shuffled, so copies add
counts and no rows.

Null texts have no words and fail the base rules. Null hosts are one host, null ids one id. Repeated rows come out as often as they
came in; other columns are not read (`remove_frequent_lines` keeps all of them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.shared import materialise, text_id

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: White space other than the line feed.
BLANKS = " \t\x0b\x0c\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, also where use puts it into lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_window_words(words: Column, most_bits: int = 63) -> Column:
    """Number of words inside three-word windows that occur twice or more in an array of words.

    At most `most_bits` of a window's hash are compared before the words are.
    """
    shift = lambda name, x, by: F.call_function(name, x, by)

    def counted(places: Column) -> Column:
        def covered(p: Column) -> Column:
            new = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3)).cast("long"))
            return F.aggregate(new, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(F.sort_array(places), covered)

    def by_words(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.struct(*(F.get(w, i + j).alias(f"w{j}") for j in range(3))).alias("words"), i.alias("place")))

        def again(s: Column) -> Column:
            near = lambda x, j: F.coalesce(x["words"] == F.get(s, j)["words"], F.lit(False))
            return counted(F.transform(F.filter(s, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["place"]))

        return let(F.sort_array(every), again)

    def by_numbers(w: Column, bits: Column) -> Column:
        place = lambda v: v.bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        hashed = lambda v: shift("shiftright", v, bits)

        def number(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND((1 << most_bits) - 1)
            return shift("shiftleft", h, bits).bitwiseOR(i.cast("long"))

        def candidates(s: Column) -> Column:
            near = lambda v, j: F.coalesce(hashed(v) == hashed(F.get(s, j)), F.lit(False))
            return F.filter(s, lambda v, i: near(v, i - 1) | near(v, i + 1))

        def settled(c: Column) -> Column:
            def other_words(v: Column, i: Column) -> Column:
                u = F.get(c, i - 1)
                equal = [F.get(w, place(v) + j) == F.get(w, place(u) + j) for j in range(3)]
                return F.coalesce((hashed(v) == hashed(u)) & ~(equal[0] & equal[1] & equal[2]), F.lit(False))

            mixed = F.array_contains(F.transform(c, other_words), True)
            return F.when(F.size(c) == 0, F.lit(0).cast("long")).when(mixed, by_words(w)).otherwise(counted(F.transform(c, place)))

        numbers = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), number))
        return let(let(numbers, candidates), settled)

    def of(w: Column) -> Column:
        return let(F.length(F.bin(F.size(w).cast("long"))), lambda bits: by_numbers(w, bits))

    return F.coalesce(let(F.when(F.size(words) >= 3, words), lambda w: F.when(w.isNotNull(), of(w))), F.lit(0)).cast("long")


def base_rules(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, text_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row."""
    rows = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    counted = rows.select(
        "doc_id",
        "host",
        text_id("text").alias("text_id"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_window_words(w).alias("repeat"))).alias("of_words"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    n, repeat = F.col("of_words.n"), F.col("of_words.repeat")
    return counted.select(
        "doc_id", "host", "text_id", n.alias("n_words"), F.col("of_words.chars").alias("word_chars"), "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), ((n < 50) | (100 * repeat > 50 * n)).alias("base_failed")
    )


def raw_lines(text: Column) -> Column:
    """The lines of a text in lower case, numbers as 0, as many as `split(text, "\\n")` gives; form() makes them normal."""
    return F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "\n")


def form(line: Column) -> Column:
    """A raw line without the white space around it, wherever in its text it stands."""
    return F.btrim(line, F.lit(BLANKS))


def text_lines(docs: DataFrame) -> DataFrame:
    """host, text_id, line (128 bits of the normal line), words: once for each different text of a host and line in it, from (host, text).

    words is summed over repeats of the line and copies of the text alike, for use as a share of the text's sum.
    """
    rows = docs.select("host", F.coalesce("text", F.lit("")).alias("text"))
    each = rows.select("host", text_id("text").alias("text_id"), F.explode(raw_lines(F.col("text"))).alias("x")).select("host", "text_id", form(F.col("x")).alias("x")).where("x <> ''")
    return each.select("host", "text_id", text_id("x").alias("line"), F.regexp_count("x", F.lit(WORD)).cast("long").alias("n")).groupBy("host", "text_id", "line").agg(F.sum("n").alias("words"))


def lost_lines(documents: DataFrame, lines: DataFrame, least: int, share: float, most: int) -> DataFrame:
    """host, text_id, lost and whole (words, both summed over copies), gone_lines of the texts that hold frequent lines.

    documents has rows (host, doc_id, text_id), lines is text_lines of the same rows.
    """
    texts = documents.select("doc_id", "host", "text_id").distinct().groupBy("host", "text_id").agg(F.count("*").alias("docs"))
    limits = texts.groupBy("host").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.sum("docs") * share))).alias("limit"))
    held = lines.alias("t").join(texts.alias("d"), F.col("t.host").eqNullSafe(F.col("d.host")) & (F.col("t.text_id") == F.col("d.text_id"))).select("t.host", "line", "docs")
    counts = held.groupBy("host", "line").agg(F.sum("docs").alias("n")).where(F.col("n") > least)
    frequent = counts.alias("c").join(limits.alias("l"), F.col("c.host").eqNullSafe(F.col("l.host"))).where("n > limit").select("c.host", "line")
    frequent = materialise(frequent)
    marked = lines.alias("t").join(frequent.withColumn("gone", F.lit(True)).alias("f"), F.col("t.host").eqNullSafe(F.col("f.host")) & (F.col("t.line") == F.col("f.line")), "left")
    lost = F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0))
    return marked.groupBy("t.host", "text_id").agg(lost.alias("lost"), F.sum("words").alias("whole"), F.collect_list(F.when(F.col("gone"), F.col("t.line"))).alias("gone_lines")).where("lost > 0")


def remove_frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", least: int = 20, share: float = 0.005, most: int = 1000, depleted: float = 0.5, enough: int = 50) -> DataFrame:
    """docs without the frequent lines of their texts, and without the documents that are depleted by that.

    Other lines stay as they are; texts without frequent lines, null and short ones too, are unchanged.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), whole.alias("text"))
    lost = lost_lines(rows.select("doc_id", "host", text_id("text").alias("text_id")), materialise(text_lines(rows)), least, share, most)
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("host"), text_id(whole).alias("text_id")).alias("r")
    both = held.join(lost.alias("x"), F.col("r.host").eqNullSafe(F.col("x.host")) & (F.col("r.text_id") == F.col("x.text_id")), "left").select("row", "gone_lines", "lost", "whole")
    old = F.col("row").getField(text)
    pairs = F.arrays_zip(F.split(old, "\n").alias("raw"), raw_lines(old).alias("low"))
    rest = F.filter(pairs, lambda x: (form(x["low"]) == "") | ~F.array_contains(F.col("gone_lines"), text_id(form(x["low"]))))
    cleaned = F.array_join(F.transform(rest, lambda x: x["raw"]), "\n")
    new = both.withColumn("new", F.when(F.col("gone_lines").isNull(), old).otherwise(cleaned))
    stays = F.col("gone_lines").isNull() | ((F.col("lost") <= depleted * F.col("whole")) & (F.regexp_count("new", F.lit(WORD)) >= enough))
    return new.where(stays).select(*(F.col("new").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def quality_rules(docs: DataFrame, host: str = "source", least: int = 20, share: float = 0.005, most: int = 1000, depleted: float = 0.5, enough: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, left_words."""
    base = materialise(base_rules(docs, host))
    lines = materialise(text_lines(docs.select(F.col(host).alias("host"), "text")))
    lost = lost_lines(base, lines, least, share, most).drop("gone_lines")
    judged = base.alias("b").join(lost.alias("x"), F.col("b.host").eqNullSafe(F.col("x.host")) & (F.col("b.text_id") == F.col("x.text_id")), "left")
    left = F.when(F.col("lost").isNull(), F.col("n_words")).otherwise(F.expr("n_words * (whole - lost) div whole"))
    rich = F.col("lost").isNull() | ((F.col("lost") <= depleted * F.col("whole")) & (left >= enough))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & rich).alias("kept"), left.alias("left_words"))


ORACLE_SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text from documents
), worded as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
         [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from docs
), windows as (
  select rid, i, [w[i], w[i + 1], w[i + 2]] as x from (select rid, w, unnest(range(1, len(w) - 1)) as i from worded)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, x) as n from windows) where n > 1
), repeats as (
  select rid, count(distinct i + j) as n_repeat_words from twice, (values (0), (1), (2)) as o(j) group by rid
), base as (
  select w.rid, doc_id, host, text, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from worded w left join repeats r on w.rid = r.rid
), texts as (
  select host, text, count(*) as docs from (select distinct doc_id, host, text from docs) group by all
), text_lines as (
  select host, text, docs, x as line, sum(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) as words
  from (select host, text, docs, trim(unnest(string_split(regexp_replace(lower(text), '[0-9]+', '0', 'g'), chr(10))), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as x from texts)
  where x <> '' group by all
), limits as (
  select host, greatest(20, least(1000, ceil(sum(docs) * 0.005))) as most from texts group by host
), frequent as (
  select t.host, line from (select host, line, sum(docs) as n from text_lines group by all) t join limits l on t.host is not distinct from l.host where n > most
), lost as (
  select t.host, t.text, sum(case when f.line is not null then words else 0 end)::bigint as lost, sum(words)::bigint as whole
  from text_lines t left join frequent f on t.host is not distinct from f.host and t.line = f.line group by all
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and (coalesce(lost, 0) = 0 or (lost <= 0.5 * whole and n_words - lost >= 50)) as kept,
       n_words - coalesce(lost, 0) as left_words
from base b left join lost l on b.host is not distinct from l.host and b.text = l.text
"""

#: remove_frequent_lines with `least` 5, as op9_document_lines gives it.
LINES_SQL = (
    ORACLE_SQL.partition("), lost as (")[0].replace("greatest(20,", "greatest(5,")
    + r"""), of_host as (
  select host, list(line) as gone from frequent group by host
), marked as (
  select doc_id, d.text, coalesce(list_transform(string_split(d.text, chr(10)), lambda x: coalesce(list_contains(gone, trim(regexp_replace(lower(x), '[0-9]+', '0', 'g'), chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), false)), []) as is_gone,
         string_split(d.text, chr(10)) as lines
  from docs d left join of_host h on d.host is not distinct from h.host
), cleaned as (
  select doc_id, text, list_contains(is_gone, true) as touched, array_to_string([lines[i] for i in range(1, len(lines) + 1) if not is_gone[i]], chr(10)) as cleaned from marked
), sized as (
  select *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as before, len(regexp_extract_all(cleaned, '[^\x20\x09-\x0D]+')) as after from cleaned
)
select doc_id, after::bigint as n_words, length(cleaned)::bigint as n_chars, sha256(cleaned) as text_sha256 from sized
where not touched or (before - after <= 0.5 * before and after >= 50)
"""
)
