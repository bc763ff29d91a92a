"""Operator 11: what each of five filters removes, in every order in which they can stand.

A text fails A with fewer than 50 words, B if under 65 % of its words are different, C if over 5 % of its code points are A-Z, D if it holds
one of `#$%&*|`, and E if a row with a smaller id has the same text, anywhere in the table.

1. Rows are range-sorted by the fingerprint of the text (md5), the text and the id, so that equal texts stand in a row. Ranges are cut by fingerprint, id
   and row, never by text: copies of one text, however many, are spread over ranges, and no text reaches the driver.
2. A task compares every row with the one before it. A row whose id is not the first of its run of equal texts fails E; the conditions A to D are
   worked out once a run.
3. Boundaries: only rows with the first id of a run of a task's first fingerprint are left open. Every task also gives the digest and the first id of the runs
   of its first and last fingerprint; an open row fails E if any task has a smaller id for its digest.
4. The five failures of a row are one mask. Rows are counted by part and mask, with good and toxic ones; such counters are additive, 32 a part at most, and
   all figures of all orders follow from them.

Null texts are empty (and fail A), null sources are the part "". A row without an id fails E never and makes no other row fail. Rows with the same id are no
duplicates of each other; each counts. A document is good or toxic if any of its label rows says so. An empty table has no parts. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewise.llm.shared import map_texts, materialise, scratch, text_id

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 50, 65, 5
_SYMBOL = re.compile(rb"[#$%&*|]")
_NO_CAPITALS = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_TAILS = bytes(range(0x80, 0xC0))
#: The mask of a row that tells the first id of a run instead.
_RUN = -1


def own_failures(text: bytes) -> int:
    """The mask of A to D (1, 2, 4, 8) of a text as UTF-8."""
    words = text.split()  # of bytes: at space and \x09-\x0D
    capitals, points = len(text.translate(None, _NO_CAPITALS)), len(text.translate(None, _TAILS))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DIFFERENT * len(words)) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | (_SYMBOL.search(text) is not None) << 3


def _compared(doc_id: pa.DataType):
    """Rows (doc_id, part, text, print) sorted by print, text and doc_id -> doc_id, part, mask and edge (see the module, 2 and 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_print = text = print_ = None  # of the task; of the row before
        mask, first_id, edge = 0, pa.nulls(1, doc_id), None  # of the run that goes on
        last: list[tuple[object, bytes]] = []  # first id and digest of the runs of the print that goes on
        out = pa.schema([("doc_id", doc_id), ("part", pa.string()), ("mask", pa.int32()), ("edge", pa.binary())])

        def runs(found: list[tuple[object, bytes]]) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], doc_id), pa.nulls(n, pa.string()), pa.array([_RUN] * n, pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            n, texts, prints = batch.num_rows, batch.column("text"), batch.column("print")
            ids = pa.concat_arrays([first_id, batch.column("doc_id")])  # at 0 the first id of the run that goes on
            begins = np.empty(n, bool)
            begins[0] = text is None or texts[0].as_py() != text
            begins[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(begins)
            run_of = np.cumsum(begins)  # 0: the run that goes on
            masks, edges, run_ids, at_edge = [mask], [edge], [0], []
            for s in starts.tolist():
                text, now = texts[s].as_py(), prints[s].as_py()
                whole = text.encode()
                first_print = now if first_print is None else first_print
                if now != print_:
                    last = []
                print_ = now
                digest = None
                if now == first_print or now == prints[n - 1].as_py():
                    digest = sha256(whole).digest()
                    last.append((ids[s + 1].as_py(), digest))
                    if now == first_print:
                        at_edge.append(last[-1])
                masks.append(own_failures(whole))
                edges.append(digest if now == first_print else None)
                run_ids.append(s + 1)
            first = pc.take(ids, pa.array(np.array(run_ids)[run_of]))
            later = pc.fill_null(pc.not_equal(batch.column("doc_id"), first), False).to_numpy(zero_copy_only=False)
            found = np.array(masks, np.int32)[run_of] | np.where(later, 16, 0).astype(np.int32)
            open_ = pa.array(~later)
            edge_of = pc.if_else(open_, pc.take(pa.array(edges, pa.binary()), pa.array(run_of)), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(found), edge_of], schema=out)
            if at_edge:
                yield runs(at_edge)
            mask, edge, first_id = masks[-1], edges[-1], first.slice(n - 1, 1)
        if last and print_ != first_print:
            yield runs(last)

    return run


def failures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, mask (A 1, B 2, C 4, D 8, E 16). Lazy, over written rows of ids and numbers."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"print": text_id("text"), "row": F.monotonically_increasing_id()})
    by_id = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange("print", by_id, "row").drop("row").sortWithinPartitions("print", "text", by_id)
    schema = T.StructType([rows.schema["doc_id"]]).add("part", "string").add("mask", "integer").add("edge", "binary")
    compared = materialise(map_texts(dealt, _compared(to_arrow_type(rows.schema["doc_id"].dataType)), schema))
    runs = compared.where(F.col("mask") == _RUN).groupBy("edge").agg(F.min("doc_id").alias("first_id"))
    known = compared.where((F.col("mask") != _RUN) & F.col("edge").isNull()).select("doc_id", "part", "mask")
    open_ = compared.where((F.col("mask") != _RUN) & F.col("edge").isNotNull()).join(runs, "edge")
    late = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return known.unionByName(open_.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask")))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask) of rows (doc_id, part, mask) -> n, good, toxic. Counters of parts of a table add up, but for E, which is about the whole table."""
    any_is = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    flags = materialise(labels.groupBy("doc_id").agg(any_is("quality"), any_is("toxic")))  # written, so that the join can split a hot id
    of_row = rows.alias("r").join(flags.alias("l"), F.col("r.doc_id") == F.col("l.doc_id"), "left").select("r.part", "r.mask", "l.quality", "l.toxic")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias({"quality": "good"}.get(c, c))
    return of_row.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality"), total("toxic"))


def report(counted: DataFrame, orders: list[str] = ORDERS) -> DataFrame:
    """counters -> one row per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A step looks at masks only: it removes those with its filter's bit and none of the earlier filters'. A mask of k failures is removed by each of them in
    120 / k of the 120 orders, which gives the Shapley sum.
    """
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.instr(letters, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    order, step = F.col("filter_order"), F.col("step")
    steps = steps.withColumns({"own": bits(F.substring(order, step, F.lit(1))), "before": bits(F.substring(order, F.lit(1), step - 1))})

    def total(when, field: str = "n", times=None) -> Column:
        """The sum of a field over the masks for which `when` holds."""
        value = lambda c: c[field] if times is None else c[field] * times(c)
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(when(c), value(c)).otherwise(0))

    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    removed = lambda c: fails(c) & ~gone(c)
    share = lambda c: F.floor(F.lit(len(ORDERS)) / F.bit_count(c["mask"]))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(fails, times=share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, orders: list[str] = ORDERS) -> DataFrame:
    """The report over documents (doc_id, source, text) and labels (doc_id, quality, toxic); tables on the way go, its counters stay."""
    with scratch(docs.sparkSession) as keep:
        counted = keep(materialise(counters(failures(docs), labels)))
    return report(counted, orders)


ORACLE_SQL = r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), flags as (
  select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as toxic from labels group by doc_id
), failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(docs.doc_id > min(docs.doc_id) over (partition by text), false)::int as mask
  from docs left join flags on docs.doc_id = flags.doc_id
), cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, mask
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as b
), steps as (
  select v.c || w.c || x.c || y.c || z.c as filter_order, unnest([1, 2, 3, 4, 5]) as step, unnest([v.b, w.b, x.b, y.b, z.b]) as own, unnest([0, v.b, v.b + w.b, v.b + w.b + x.b, v.b + w.b + x.b + y.b]) as before
  from letters v, letters w, letters x, letters y, letters z
  where v.b <> w.b and v.b <> x.b and v.b <> y.b and v.b <> z.b and w.b <> x.b and w.b <> y.b and w.b <> z.b and x.b <> y.b and x.b <> z.b and y.b <> z.b
)
select part, filter_order, step, coalesce(sum(n) filter (mask & (before | own) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) filter (mask & own <> 0), 0)::bigint as shapley
from cells, steps group by part, filter_order, step
"""
