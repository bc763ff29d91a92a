"""Operator 5: mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

1. The size of a document is its number of words. Sources in order of their names (null last) weigh 1, 2, 3, repeating, and share the
   sum of all sizes; a target stops at `repeats` times its source's size, and what is over is shared again by weight.
2. The mix consists of about `blocks` blocks of equal numbers of words. Sources get whole blocks by the highest quotients
   target / (2k + 1); the same rule deals a source's blocks to its shards by their sizes.
3. A shard lays its documents end to end in a seeded order. A quota above the shard's size takes whole rounds of it first; the rest
   is a run of blocks from a seeded block on, around the end.

A shard is a hash of id and text within its source. Only numbers are laid out, equal rows as one with their number, so a row that
makes up a third of a table is one entry. Shares are dealt in two levels of bounded size: one task sees the sources, one the shards of a source (about
MOST_SHARDS at most; shards grow with the input beyond `shard_words`), and one the entries of a shard, some millions of numbers at 100 TB. Texts
meet the result at the end, by a hash of the whole row.

Null texts have size 0; null sources are one source, null ids one id. Repeated rows count each time. A source
without words has target 0. An empty table gives an empty result. Other columns are not read (`sample_mix` keeps all of them, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
MOST_SHARDS = 16384


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *values: Column) -> Column:
    """60 bits of md5 over seed and values as text; nulls as empty text."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(v.cast("string"), F.lit("")) for v in values))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], order: str, votes: str, seats: str, to: str) -> DataFrame:
    """parties with the column `to`: the whole numbers of `seats` (one value for each group) that Sainte-Laguë's highest quotients give.

    With n parties and total V, rounding seats * votes / V is off by at most n / 2 in all, and the quotients that it
    takes are the highest. What is missing or over is settled among the next ceil(n * votes / V) + 2 quotients of each
    party, which are enough (seats at V / (seats + n) already reach the sum). Ties go to the lower `order`.
    """
    whole = Window.partitionBy(*group)
    total = F.sum(F.col(votes).cast("double")).over(whole)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    rounded = parties.withColumns({"_share": share, "_n": F.count("*").over(whole)})
    rounded = rounded.withColumn("_got", F.when(F.col("_share") > 0, F.floor(F.col(seats) * F.col("_share") + 0.5)).otherwise(0).cast("long"))
    rounded = rounded.withColumn("_left", F.when(total > 0, F.col(seats) - F.sum("_got").over(whole)).otherwise(0))
    reach = (F.ceil(F.col("_n") * F.col("_share")) + 2).cast("int")
    steps = F.explode(F.sequence(F.lit(0), reach))
    more = F.col("_left") > 0
    near = rounded.where("_left <> 0").withColumn("_i", steps)
    near = near.withColumn("_k", F.when(more, F.col("_got") + F.col("_i")).otherwise(F.col("_got") - 1 - F.col("_i"))).where("_k >= 0")
    quotient = F.col(votes) / (2 * F.col("_k") + 1)
    high = F.row_number().over(whole.orderBy(quotient.desc(), F.col(order)))
    low = F.row_number().over(whole.orderBy(quotient, F.col(order).desc()))
    near = near.withColumns({"_high": high, "_low": low})
    change = near.groupBy(F.col(order).alias("_order")).agg(
        F.sum(F.when(more, (F.col("_high") <= F.col("_left")).cast("long")).otherwise(-(F.col("_low") <= -F.col("_left")).cast("long"))).alias("_change")
    )
    settled = rounded.join(change, F.col(order) == F.col("_order"), "left")
    return settled.withColumn(to, F.col("_got") + F.coalesce("_change", F.lit(0))).drop("_share", "_n", "_got", "_left", "_order", "_change")


def source_targets(sizes: DataFrame, repeats: int) -> DataFrame:
    """One row per source of (source, size, n rows like this): source_no, n_docs, source_size, total, target."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    alone = Window.partitionBy(F.lit(0))
    per = per.withColumns({"source_no": F.row_number().over(alone.orderBy(F.col("source").asc_nulls_last())).cast("long"), "total": F.sum("source_size").over(alone)})
    per = per.withColumns({"weight": (F.col("source_no") - 1) % 3 + 1, "most": repeats * F.col("source_size")})
    filled = alone.orderBy(F.col("most") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.col("total") - (F.sum("most").over(filled) - F.col("most"))
    weights = F.sum("weight").over(alone) - (F.sum("weight").over(filled) - F.col("weight"))
    per = per.withColumn("level", rest / weights)
    full = F.col("most") <= F.col("weight") * F.col("level")  # holds for the first ones of this order; the next one's level counts
    per = per.withColumn("level", F.first(F.when(~full, F.col("level"))).over(alone.orderBy(full, F.col("most") / F.col("weight"), "source_no")))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most").cast("double")))
    return per.select("source", "source_no", "n_docs", "source_size", "total", target.alias("target"))


def counted_up(df: DataFrame, n: str, to: str) -> DataFrame:
    """Every row n times, with `to` from 0 to n - 1; in two steps, so that n has no bound."""
    step = 1 << 16
    high = df.where(F.col(n) > 0).withColumn("_high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step))))
    low = F.explode(F.sequence(F.col("_high") * step, F.least(F.col(n), (F.col("_high") + 1) * step) - 1))
    return high.withColumn(to, low).drop("_high")


def _sized(docs: DataFrame, seed: int, *tie: Column) -> DataFrame:
    """doc_id, source, size, place and tie of the different rows, with their number n."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), seeded(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("place"), *tie)
    return materialise(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))


def mix_sources(docs: DataFrame, blocks: int = 1_000_000, shard_words: int = 1 << 16, repeats: int = 3, seed: int = 17) -> DataFrame:
    """One row per document of (doc_id, source, text): doc_id, size, source_size, target, taken, source, shard.

    taken: words that the mix takes of the document, repeats counted; at most `repeats` times its size.
    """
    return _mixed(_sized(docs, seed), ["doc_id", "size"], blocks, shard_words, repeats, seed).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def sample_mix(docs: DataFrame, blocks: int = 1_000_000, shard_words: int = 1 << 16, repeats: int = 3, seed: int = 17) -> DataFrame:
    """docs with every row as often as the mix takes its words, to the nearest whole number: 0 to `repeats` times."""
    tie = lambda: (F.xxhash64(*docs.columns).alias("tie"), F.xxhash64(F.lit(seed), *docs.columns).alias("tie2"))
    mixed = _mixed(_sized(docs, seed, *tie()), ["doc_id", "size", "tie", "tie2"], blocks, shard_words, repeats, seed)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("long")
    wanted = mixed.groupBy("tie", "tie2").agg(F.sum(times).alias("times"), F.count("*").alias("n")).where("times > 0")
    both = docs.select(F.struct(*docs.columns).alias("row"), *tie()).join(wanted, ["tie", "tie2"])
    single = both.where("n = 1").select("row", "times")
    repeated = both.where("n > 1").groupBy("tie", "tie2").agg(F.first("row").alias("row"), F.first("times").alias("times")).select("row", "times")
    return counted_up(single.unionByName(repeated), "times", "time").select("row.*")


def _mixed(sized: DataFrame, order: list[str], blocks: int, shard_words: int, repeats: int, seed: int) -> DataFrame:
    """The rows of sized, each n times, with source_size, target, shard and taken."""
    sources = source_targets(sized, repeats)
    sources = sources.withColumns(
        {
            "block": F.greatest(F.lit(1), F.ceil(F.col("total") / blocks)),
            "shards": F.ceil((F.col("source_size") + F.col("n_docs")) / F.greatest(F.lit(shard_words), F.ceil(F.col("total") / MOST_SHARDS))),
        }
    )
    sources = sources.withColumn("seats", F.floor(F.col("total") / F.col("block") + 0.5)).withColumn("one", F.lit(0))
    sources = materialise(apportion(sources, ["one"], "source_no", "target", "seats", "quota").drop("one", "seats"))

    at = sources.select(F.col("source").alias("of"), "source_no", "shards", "source_size", "target")
    placed = sized.join(at, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("shard", (F.col("place") % F.col("shards")).cast("long")).withColumn("shard_key", F.shiftleft("source_no", 32) + F.col("shard"))

    shards = placed.groupBy("shard_key", "source_no").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"))
    shards = apportion(shards.join(sources.select("source_no", "quota", "block"), "source_no"), ["source_no"], "shard_key", "shard_size", "quota", "shard_quota")
    words = F.least(F.col("shard_quota") * F.col("block"), repeats * F.col("shard_size"))
    first = seeded(seed, F.col("shard_key")) % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))) * F.col("block")
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.greatest("shard_size", F.lit(1)))).otherwise(0)
    shards = shards.select("shard_key", "shard_size", rounds.alias("rounds"), (words - rounds * F.col("shard_size")).alias("rest"), first.alias("first"))

    line = Window.partitionBy("shard_key").orderBy("place", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.join(shards, "shard_key").withColumn("before", F.sum(F.col("size") * F.col("n")).over(line) - F.col("size") * F.col("n"))
    laid = counted_up(laid, "n", "copy").withColumn("begin", F.col("before") + F.col("copy") * F.col("size"))
    until = F.col("first") + F.col("rest")
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), hi) - F.greatest(F.col("begin"), lo))
    part = over(F.col("first"), F.least(until, F.col("shard_size"))) + over(F.lit(0), until - F.col("shard_size"))
    taken = (F.col("rounds") * F.col("size") + part).cast("long")
    return laid.withColumn("taken", taken)


#: The same rows, with all quotients listed and ranked.
ORACLE_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as place
  from documents
), per as (
  select source, sum(size)::bigint as source_size, count(*)::bigint as n_docs, row_number() over (order by source asc nulls last)::bigint as source_no,
         (sum(sum(size)) over ())::bigint as total
  from sized group by source
), weighed as (
  select *, (source_no - 1) % 3 + 1 as weight, 3 * source_size as most from per
), levelled as (
  select *, (total - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0)) /
            (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed window o as (order by most / weight, source_no)
), targets as (
  select *, least(most::double, coalesce(weight * first_value(case when most > weight * level then level end) over (order by most <= weight * level, most / weight, source_no), most::double)) as target,
         greatest(1, ceil(total / 1000000))::bigint as block,
         ceil((source_size + n_docs) / greatest(65536, ceil(total / 16384)))::bigint as shards
  from levelled
), seats as (
  select *, floor(total / block + 0.5)::bigint as seats from targets
), source_quotients as (
  select source_no, seats, row_number() over (order by target / (2 * k + 1) desc, source_no) as n
  from (select *, unnest(range(0, seats + 1)) as k from seats where target > 0)
), quotas as (
  select source_no, count(*)::bigint as quota from source_quotients where n <= seats group by source_no
), placed as (
  select d.doc_id, d.source, d.size, s.source_no, s.source_size, s.target, s.block,
         place, place % s.shards as shard, (s.source_no << 32) + place % s.shards as shard_key
  from sized d join seats s on d.source is not distinct from s.source
), shards as (
  select shard_key, source_no, block, sum(size)::bigint as shard_size from placed group by all
), shard_quotients as (
  select shard_key, quota, row_number() over (partition by source_no order by shard_size / (2 * k + 1) desc, shard_key) as n
  from (select s.*, q.quota, unnest(range(0, q.quota + 1)) as k from shards s join quotas q using (source_no) where shard_size > 0)
), shard_quotas as (
  select shard_key, count(*)::bigint as shard_quota from shard_quotients where n <= quota group by shard_key
), taking as (
  select s.shard_key, s.shard_size, least(coalesce(q.shard_quota, 0) * s.block, 3 * s.shard_size) as words,
         ('0x' || substr(md5('17:' || s.shard_key), 1, 15))::bigint % greatest(1, ceil(s.shard_size / s.block)::bigint) * s.block as first
  from shards s left join shard_quotas q using (shard_key)
), laid as (
  select p.*, t.*, case when shard_size > 0 then words // shard_size else 0 end as rounds,
         case when shard_size > 0 then words % shard_size else 0 end as rest,
         sum(size) over (partition by p.shard_key order by place, doc_id, size rows unbounded preceding) as until_end
  from placed p join taking t using (shard_key)
)
select doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(until_end, first + rest, shard_size) - greatest(until_end - size, first))
        + greatest(0, least(until_end, first + rest - shard_size) - (until_end - size)))::bigint as taken,
       source, shard
from laid
"""
