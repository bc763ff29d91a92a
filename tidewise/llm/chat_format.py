"""Operator 2: preference formatting of chosen and rejected conversations.

For each key the longest common prefix of turns (role and text equal) is rendered once as the prompt; what follows in
either conversation is its completion, with a mask: the spans of the completion that are trained on, which are the texts of
assistant turns with their end marks.

Everything works on rows of turns with DataFrame functions, so a key may hold any share of all rows: turns get their numbers by a sort over
ranges of (key, turn, role, text) and counts of those ranges, offsets by sums over buckets of BUCKET turns, and a prompt or a completion
longer than PIECE code points comes out as several rows, its pieces in order. No task sees more than a range, a bucket or a piece.

Turns are ordered by number (nulls first), then role and text, so repeated turns stay and ties have one order. Null roles and texts count as
empty. A conversation without a partner is compared with an empty one. Equal conversations have empty completions and
masks. Turns with a null key belong to no conversation and are left out. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.mixing import counted_up
from tidewise.llm.shared import materialise

#: What a rejected conversation says where there is nothing else to say.
REFUSAL = "I have no answer to that."
BUCKET, PIECE = 4096, 1 << 20


def numbered(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, n (place in the conversation, from 0), role, text of every turn."""
    order = ["key", "turn", "role", "text"]
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.groupBy(*order).agg(F.count("*").alias("copies"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id())
    placed = materialise(sorted_rows).withColumn("range", F.shiftright("rid", 33))  # the written numbers count
    ranges = placed.groupBy("key", "range").agg(F.sum("copies").alias("size"))
    ranges = ranges.select("key", "range", (F.sum("size").over(Window.partitionBy("key").orderBy("range")) - F.col("size")).alias("before"))
    within = Window.partitionBy("key", "range").orderBy("rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("first", F.sum("copies").over(within) - F.col("copies")).join(ranges, ["key", "range"])
    return counted_up(placed, "copies", "copy").select("key", (F.col("before") + F.col("first") + F.col("copy")).alias("n"), "role", "text")


def weaker_replies(turns: DataFrame) -> DataFrame:
    """Numbered turns beside a rejected conversation (aligned): each last assistant turn has the text of the first one, or a refusal if there is one assistant turn only."""
    said = turns.where("role = 'assistant'").groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("said"), F.min_by("text", "n").alias("first"))
    new = said.select("key", "n", F.when(F.col("said") > 1, F.col("first")).otherwise(F.lit(REFUSAL)).alias("new"))
    both = turns.join(new, ["key", "n"], "left")
    other = F.col("new").isNotNull() & (F.col("new") != F.col("text"))
    return both.select("key", "n", F.struct("role", "text").alias("c"), F.when(other, F.struct("role", F.col("new").alias("text"))).alias("r"), (~other).alias("same"))


def aligned(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """key, n, c and r (role and text of the turns n, null where a side has none or, for r, the same), same, from numbered turns."""
    side = lambda df, x: df.select("key", "n", F.struct("role", "text").alias(x))
    both = side(chosen, "c").join(side(rejected, "r"), ["key", "n"], "full")
    same = F.col("c").eqNullSafe(F.col("r"))
    return both.select("key", "n", "c", F.when(~same, F.col("r")).alias("r"), same.alias("same"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns twice -> key, piece, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask; masks as spans of the completion."""
    return format_aligned(aligned(numbered(chosen, key, turn, role, text), numbered(rejected, key, turn, role, text))).withColumnRenamed("key", key)


def format_aligned(both: DataFrame) -> DataFrame:
    """The same for rows of aligned."""
    both = materialise(both)
    bucket = F.floor(F.col("n") / BUCKET)
    size = lambda x: F.coalesce(F.length(rendered(x.role, x.text)), F.lit(0)).cast("long")
    sizes = {"c_size": size(F.col("c")), "r_size": F.when(F.col("same"), size(F.col("c"))).otherwise(size(F.col("r")))}
    rows = both.select("key", "n", bucket.alias("bucket"), "c", "r", "same", *[v.alias(k) for k, v in sizes.items()], (~F.col("same")).alias("differs"))

    in_bucket = Window.partitionBy("key", "bucket")
    so_far = in_bucket.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "c_at": F.sum("c_size").over(so_far) - F.col("c_size"),
            "r_at": F.sum("r_size").over(so_far) - F.col("r_size"),
            "split": F.min(F.when(F.col("differs"), F.col("n"))).over(in_bucket),
        }
    )
    common = F.sum(F.when(F.col("split").isNull() | (F.col("n") < F.col("split")), F.col("c_size")).otherwise(0))
    buckets = rows.groupBy("key", "bucket").agg(F.first("split").alias("split"), F.max("n").alias("last"), F.sum("c_size").alias("c_size"), F.sum("r_size").alias("r_size"), common.alias("common"))
    whole = Window.partitionBy("key")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = F.coalesce(F.min("split").over(whole), F.max("last").over(whole) + 1)
    buckets = buckets.withColumns({"p": split, "c_before": F.sum("c_size").over(earlier) - F.col("c_size"), "r_before": F.sum("r_size").over(earlier) - F.col("r_size")})
    buckets = buckets.withColumn("prompt_size", F.sum(F.when(F.col("bucket") <= F.floor(F.col("p") / BUCKET), F.col("common")).otherwise(0)).over(whole))
    rows = rows.drop("split").join(buckets.select("key", "bucket", "p", "c_before", "r_before", "prompt_size"), ["key", "bucket"])

    after = F.col("n") >= F.col("p")
    turn = lambda stream, x, at: F.when(x.isNotNull(), F.struct(F.lit(stream).alias("stream"), at.alias("at"), x.role.alias("role"), x.text.alias("text")))
    c, r = F.col("c"), F.when(F.col("same"), F.col("c")).otherwise(F.col("r"))
    c_at, r_at = F.col("c_at") + F.col("c_before"), F.col("r_at") + F.col("r_before")
    streams = F.when(~after, F.array(turn(0, c, c_at))).otherwise(F.array(turn(1, c, c_at - F.col("prompt_size")), turn(2, r, r_at - F.col("prompt_size"))))
    placed = rows.select("key", "p", "n", F.explode(F.array_compact(streams)).alias("x")).select("key", "p", "n", "x.*").withColumn("piece", F.floor(F.col("at") / PIECE))

    def listed(stream: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("stream") == stream, F.struct("n", "at", "role", "text"))))

    pieces = placed.groupBy("key", "piece").agg(F.first("p").alias("n_prompt_turns"), *[listed(k).alias(name) for k, name in enumerate(("prompt", "chosen", "rejected"))])
    render = lambda x: F.array_join(F.transform(x, lambda t: rendered(t["role"], t["text"])), "")

    def mask(x: Column) -> Column:
        """array<struct<start, end>>: code points of the completion, end exclusive."""
        end = lambda t: t["at"] + F.length(rendered(t["role"], t["text"]))
        spans = F.filter(x, lambda t: t["role"] == "assistant")
        return F.transform(spans, lambda t: F.struct((end(t) - F.length(t["text"]) - len("<|end|>\n")).alias("start"), end(t).alias("end")))

    return pieces.select("key", "piece", "n_prompt_turns", *[render(c).alias(c) for c in ("prompt", "chosen", "rejected")], mask(F.col("chosen")).alias("chosen_mask"), mask(F.col("rejected")).alias("rejected_mask"))


#: The query: every conversation against itself with a weaker last reply; masks as start:end, comma-joined.
ORACLE_SQL = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n
  from conversations where conv_id is not null
), last as (
  select conv_id, max(n) filter (role = 'assistant') as last_n, count(*) filter (role = 'assistant') as said, max(n) as n_all, arg_min(text, n) filter (role = 'assistant') as first_text from t group by conv_id
), pairs as (
  select t.*, l.n_all, l.last_n, case when n = last_n then case when said > 1 then first_text else 'I have no answer to that.' end else text end as other
  from t join last l using (conv_id)
), prefix as (
  select conv_id, coalesce(min(n) filter (text <> other) - 1, any_value(n_all))::bigint as p from pairs group by conv_id
), parts as (
  select x.conv_id, n, p, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as c, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) as r, length(text) as lc, length(other) as lr
  from pairs x join prefix using (conv_id)
), streams as (
  select conv_id, p, n, role, 0 as s, c as x, lc as size, sum(length(c)) over w as until from parts where n <= p window w as (partition by conv_id order by n)
  union all select conv_id, p, n, role, 1, c, lc, sum(length(c)) over w from parts where n > p window w as (partition by conv_id order by n)
  union all select conv_id, p, n, role, 2, r, lr, sum(length(r)) over w from parts where n > p window w as (partition by conv_id order by n)
), placed as (
  select *, ((until - length(x)) // 1048576)::bigint as piece from streams
)
select conv_id, piece, any_value(p) as n_prompt_turns,
       coalesce(string_agg(x, '' order by n) filter (s = 0), '') as prompt,
       coalesce(string_agg(x, '' order by n) filter (s = 1), '') as chosen,
       coalesce(string_agg(x, '' order by n) filter (s = 2), '') as rejected,
       coalesce(string_agg((until - size - 8)::bigint || ':' || until::bigint, ',' order by n) filter (s = 1 and role = 'assistant'), '') as chosen_mask,
       coalesce(string_agg((until - size - 8)::bigint || ':' || until::bigint, ',' order by n) filter (s = 2 and role = 'assistant'), '') as rejected_mask
from placed group by conv_id, piece
"""
