"""Operator 13: a Merkle manifest of documents by supersteps over RDDs of tree nodes.

A leaf is the hash of a row's fields, each `-` if null, else its UTF-8 byte count, `:` and its text. The leaves of a language ascend by doc_id; every ARITY
consecutive nodes (the last run may be shorter) become their hash, until one is left, the language's subroot. Subroots by language (null first) become the root likewise.

1. Leaves are hashed where their rows are; only ids and digests travel. They are range-sorted by language and id, and numbered by a row's place in its range and the
   numbers of the ranges before, so that no language is in one task.
2. Up: in each superstep nodes send their digest to their parent. A parent that has heard all its children hashes them, is written as a row with their digests, and is active in the
   next one. It ends when no tree has more than one node on the level: after log8 of the largest language.
3. The subroots are leaves of one more tree, of the same kind.
4. Down, from the root: in each superstep nodes send every child the path they got, with the digests of that child's siblings before it. A path is at most ARITY - 1 digests a
   level. Leaves that share a parent share what it got; proofs are folded there.

The written levels cut lineage, and a superstep down depends on them and on the one above it; a lost executor repeats its part of these. A group of messages has ARITY entries at most.

Null ids come first. Rows with the same language and id stand in the order of their leaves; repeated rows are leaves of their own. An empty table gives an empty result
(there is no root). Ids have any type with an order and a text form without fractions. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.shared import materialise, scratch

ARITY = 8
DIGEST = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, idx long, n long, digest binary, children binary"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The digest (binary) of a row's fields, of which some may be replaced."""
    return F.unhex(F.sha2(F.concat(*[_field(other.get(c, F.col(c))) for c in FIELDS]), 256))


def tampered() -> Column:
    """Whether the check tampers with a row: 3 divides the crc32 of its id; no id, no tampering."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


def parent(digests: bytes) -> bytes:
    """The hash of children's digests laid end to end, as hexadecimal text."""
    return sha256(digests.hex().encode()).digest()


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with idx (from 0) within their tree by `order`, and n, the number of rows of their tree. The order should be total but for equal rows."""
    tree = F.col("tree").asc_nulls_first()
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tie.repartitionByRange(tree, *order, "tie").sortWithinPartitions(tree, *order).drop("tie")
    dealt = materialise(dealt.withColumns({"range": F.spark_partition_id(), "no": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    # a row for each range and each further tree in it
    runs = dealt.groupBy("range", "tree").agg(F.min("no").alias("begin"), F.count("*").alias("own"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("own").over(of_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own")
    runs = runs.withColumns({"before": before, "n": F.sum("own").over(of_tree)}).alias("r")
    same = (F.col("d.range") == F.col("r.range")) & F.col("d.tree").eqNullSafe(F.col("r.tree"))
    return dealt.alias("d").join(runs, same).select("d.*", (F.col("no") - F.col("begin") + F.col("before")).alias("idx"), "n").drop("range", "no")


def _up(nodes: DataFrame) -> RDD:
    """Superstep: nodes (tree, idx, n, digest) of trees with more than one -> their parents, as rows of _NODES."""
    messages = nodes.rdd.map(lambda x: ((x["tree"], x["idx"] // ARITY), (x["idx"] % ARITY, bytes(x["digest"]), x["n"])))

    def completed(group) -> Iterator[tuple]:
        (tree, idx), heard = group
        heard = sorted(heard)
        n = heard[0][2]
        assert len(heard) == min(ARITY, n - idx * ARITY), "a child is missing"
        children = b"".join(d for _, d, _ in heard)
        yield tree, idx, -(-n // ARITY), parent(children), children

    return messages.groupByKey().flatMap(completed)


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels of inner nodes, from the leaves' parents on; roots: tree, digest, level, where level 0 is a leaf) of leaves (tree, idx, n, digest)."""
    spark = leaves.sparkSession
    levels, now = [], leaves.select("tree", "idx", "n", "digest")
    roots = [now.where("n = 1").select("tree", "digest", F.lit(0).alias("level"))]
    while not (active := now.where("n > 1")).isEmpty():
        now = materialise(spark.createDataFrame(_up(active), _NODES))
        levels.append(now)
        roots.append(now.where("n = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def entry(slot: int, run: bytes) -> bytes:
    """A level of a path: slot, number of siblings, their digests."""
    at = slot * DIGEST
    return bytes([slot, len(run) // DIGEST - 1]) + run[:at] + run[at + DIGEST :]


def entries(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(slot, siblings) of each level."""
    at = 0
    while at < len(path):
        end = at + 2 + path[at + 1] * DIGEST
        yield path[at], path[at + 2 : end]
        at = end


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for slot, siblings in entries(path):
        at = slot * DIGEST
        digest = parent(siblings[:at] + digest + siblings[at:])
    return digest


def siblings(path: bytes) -> bytes:
    return b"".join(s for _, s in entries(path))


def _down(level: DataFrame, paths: RDD) -> RDD:
    """Superstep: inner nodes of a level and what each of them got ((tree, idx), (path, *more)) -> the same for their children."""

    def sent(group) -> Iterator[tuple]:
        (tree, idx), (children, (path, *more)) = group
        for slot in range(len(children) // DIGEST):
            yield (tree, idx * ARITY + slot), (entry(slot, children) + path, *more)

    return level.rdd.map(lambda x: ((x["tree"], x["idx"]), bytes(x["children"]))).join(paths).flatMap(sent)


def paths_below(levels: list[DataFrame], given: RDD) -> RDD:
    """What the nodes on the level above the leaves get, as ((tree, idx), (path, *more)); given: (level, tree, path, *more) for each root.

    A tree of one leaf has no such node; it stands for it, with the key (tree, 0).
    """
    at = lambda level: given.filter(lambda x: x[0] == level).map(lambda x: ((x[1], 0), tuple(x[2:])))
    got = at(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        got = _down(levels[k], got).union(at(k))
    return got.union(at(0)) if levels else got


def _proved(paths: RDD, leaves: RDD) -> RDD:
    """leaves ((tree, parent's idx), (slot, n, doc_id, leaf, changed leaf or None)) -> rows of the manifest."""

    def of_parent(group) -> Iterator[tuple]:
        _, (own, got) = group
        own = sorted(own, key=lambda x: x[0])
        (path, subroot, root) = next(iter(got))
        run = b"".join(x[3] for x in own)
        for slot, n, doc_id, digest, changed in own:
            whole = (entry(slot, run) if n > 1 else b"") + path
            folded = fold(changed or digest, whole)
            yield doc_id, digest.hex(), subroot.hex(), root.hex(), sha256(siblings(whole).hex().encode()).hexdigest(), folded.hex(), folded == root

    return leaves.cogroup(paths).flatMap(of_parent)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (of its siblings up to the root), folded_root and verified of the row as the check reads it."""
    spark = docs.sparkSession
    changed = F.when(tampered(), leaf(text=F.translate(F.col("text"), _UPPER, _LOWER)))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("tree"), leaf().alias("digest"), changed.alias("changed"))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])
    with scratch(spark) as keep:
        leaves = keep(materialise(placed(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest")])))
        levels, roots = grow(leaves)
        roots = materialise(roots)
        top = materialise(placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest", "level"), [F.col("lang").asc_nulls_first()]))
        top_levels, top_roots = grow(top)
        first = top_roots.select("level", "tree", "digest").rdd.map(lambda x: (x[0], x[1], b"", bytes(x[2])))
        by_parent = top.rdd.map(lambda x: ((x["tree"], x["idx"] // ARITY), (x["idx"] % ARITY, x["n"], x["lang"], bytes(x["digest"]), x["level"])))

        def of_languages(group) -> Iterator[tuple]:
            _, (own, got) = group
            own = sorted(own, key=lambda x: x[0])
            path, root = next(iter(got))
            run = b"".join(x[3] for x in own)
            for slot, n, lang, digest, level in own:
                yield level, lang, (entry(slot, run) if n > 1 else b"") + path, digest, root

        of_trees = "level int, tree string, path binary, subroot binary, root binary"
        below = keep(materialise(spark.createDataFrame(by_parent.cogroup(paths_below(top_levels, first)).flatMap(of_languages), of_trees)))
        for level in levels:
            keep(level)
    given = below.rdd.map(lambda x: (x[0], x[1], bytes(x[2]), bytes(x[3]), bytes(x[4])))
    own = leaves.rdd.map(lambda x: ((x["tree"], x["idx"] // ARITY), (x["idx"] % ARITY, x["n"], x["doc_id"], bytes(x["digest"]), None if x["changed"] is None else bytes(x["changed"]))))
    return spark.createDataFrame(_proved(paths_below(levels, given), own), schema)


_TEXT_SQL = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in FIELDS)
#: list_reduce over the bits of every byte, as DuckDB has no crc32.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, [unicode(c)::bigint for c in string_split(doc_id::varchar, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint for i in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

ORACLE_SQL = f"""
with recursive leaves as (
  select row_number() over () as k, doc_id, lang, sha256({_TEXT_SQL}) as leaf, case when {_CRC_SQL} % 3 = 0 then sha256({_TEXT_SQL.replace("text::varchar", f"translate(text, '{_UPPER}', '{_LOWER}')")}) end as changed from documents
), numbered as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from leaves
), up as (
  select 0 as level, lang, idx, n, leaf as h from numbered
  union all
  select level + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from up where n > 1 group by level, lang, idx // 8, n
), langs as (
  select lang, h as subroot, level as depth, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from up where n = 1
), top as (
  select 0 as level, place as idx, n, subroot as h from langs
  union all
  select level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' order by idx)) from top where n > 1 group by level, idx // 8, n
), runs as (
  select level, lang, idx // 8 as p, list(h order by idx) as hs from up where n > 1 group by level, lang, idx // 8
), top_runs as (
  select level, idx // 8 as p, list(h order by idx) as hs from top where n > 1 group by level, idx // 8
), entries as (
  select k, level, (idx >> (3 * level)::int) % 8 as slot, hs from numbered d join runs r on d.lang is not distinct from r.lang and d.idx >> (3 * level + 3)::int = r.p
  union all
  select k, depth + r.level, (place >> (3 * r.level)::int) % 8, hs from numbered d join langs l on d.lang is not distinct from l.lang join top_runs r on l.place >> (3 * r.level + 3)::int = r.p
), proofs as (
  select k, sha256(string_agg(array_to_string(hs[1:slot] || hs[slot + 2:], ''), '' order by level)) as proof from entries group by k
), folded as (
  select k, 0 as level, coalesce(changed, leaf) as h from numbered
  union all
  select f.k, f.level + 1, sha256(array_to_string(hs[1:slot] || [h] || hs[slot + 2:], '')) from folded f join entries e on f.k = e.k and f.level = e.level
), roots as (
  select h as root from top where n = 1
)
select d.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, h as folded_root, h = root as verified
from numbered d join langs l on d.lang is not distinct from l.lang join (select k, arg_max(h, level) as h from folded group by k) f on f.k = d.k left join proofs p on p.k = d.k, roots
"""
