"""Operator 6: n-gram Jaccard join with Bayesian pruning of MinHash candidates.

Links are the pairs of different texts whose sets of five-word shingles have a Jaccard similarity of at least `threshold`.

1. Texts with equal sets of shingles form one node (128 bits of the set); a node knows how many different texts it has.
2. Every node gets a MinHash signature of 128 values, kept as 16 bits each.
3. 32 bands of 4 values give candidates. At similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^32 < 6e-8.
4. A band with many nodes, or with long ones, is dealt as blocks of bounded size, and pairs of blocks go to tasks.
   A pair that shares several bands is looked at in the first of them only.
5. The values of a pair are compared 16 at a time. With m of n equal and a uniform prior, the pair is dropped as soon as
   P(similarity >= threshold | m, n) < tolerance. Nodes without any pair left go no further.
6. The texts of the others join them, and a task compares the signatures of its nodes again and verifies what is left exactly on the
   shingle sets. It returns one row for each node, a count and a spanning link; pairs are never written.
7. Connected components over the spanning links give the classes.

Where only classes are wanted (`drop_near_duplicates`), a task passes over pairs that are connected already, so a block of near copies costs about one
comparison a node. Blocks of a large band are then joined by one leader of each component, and only where this leaves a band in more than one component
are the pairs of blocks looked at. Link counts (`near_duplicate_classes`) need the pairs of all blocks: N nodes of one band travel N / BLOCK times.

A text without words has no shingles and so no link, except that equal texts stay one class. A text of one to four words
has one shingle, all its words. Null texts count as empty, null ids stay rows of their class, a class without any id has a
null class id, and repeated rows come out as often as they came in. Ids have any type with an order. Other columns of the input are
not read (`drop_near_duplicates` keeps all of them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.shared import map_texts, materialise, scratch, text_id
from tidewise.llm.words import chunks, identities, mix, second_hashes, shingles, words

VALUES, BAND = 128, 4
BANDS = VALUES // BAND
STEP = 16
#: Nodes of a block of a band, and their shingles (about; a longer node is a block of its own).
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: From this many pairs of a node on, its common shingles are counted with all of them at once.
MANY = 12

_RNG = np.random.default_rng(20240607)
_MULT = _RNG.integers(1, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, np.uint64)


def minhash(sets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Signatures (rows x 128, 16 bits) of the shingles of each row; zeros for a row without any."""
    out = np.zeros((len(rows) - 1, VALUES), np.uint16)
    full = np.flatnonzero(np.diff(rows))
    if len(full):
        for j in range(VALUES):
            least = np.minimum.reduceat((sets * _MULT[j] + _ADD[j]) >> np.uint64(20), rows[full])
            out[full, j] = mix(least).astype(np.uint16)
    return out


def prune_table(threshold: float, tolerance: float) -> np.ndarray:
    """least[i]: the fewest equal values among the first (i + 1) * STEP with which a pair stays.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail beyond t is P(Binomial(n + 1, t) <= m).
    """
    least = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        least.append(m)
    return np.array(least)


def set_id(first: np.ndarray, second: np.ndarray) -> bytes:
    """128 bits of a set of shingles: the sums of two independent hashes over its elements."""
    return np.array([mix(h).sum(dtype=np.uint64) for h in (first, second)], "<u8").tobytes()


def _sign(names: list[str]):
    """Batches with text -> their columns `names`, n_shingles (different ones), set_id (null without shingles) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                h, rows, starts, ends = words(data, offsets)
                s, of = shingles(h, rows)
                t, _ = shingles(second_hashes(data, starts, ends), rows)
                found = [np.unique(s[of[r] : of[r + 1]], return_index=True) for r in range(hi - lo)]
                sets = [x for x, _ in found]
                sizes = np.array([len(x) for x in sets], np.int64)
                blob = minhash(np.concatenate(sets) if sets else s, np.append(0, np.cumsum(sizes))).tobytes()
                cuts = np.arange(hi - lo + 1, dtype=np.int32) * (2 * VALUES)
                sig = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cuts), pa.py_buffer(blob)])
                ids = pa.array([set_id(x, t[of[r] + at]) if len(x) else None for r, (x, at) in enumerate(found)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(sizes), ids, sig], [*names, "n_shingles", "set_id", "sig"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if kept and (cut or kept[-1].column(key)[-1].as_py() != k[-1]):
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


class _Candidates:
    """Which pairs of a sorted table of members are looked at, and which survive the comparison of signatures."""

    def __init__(self, table: pa.Table, least: np.ndarray):
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        self.task, self.node, self.side, self.band, self.one_block, self.label = map(column, ("task", "node", "side", "band_no", "one_block", "label"))
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        self.bands = self.sig.view(np.uint64)
        self.least = least

    def left(self, i, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j), of one task, are left; i is one row or as many as j."""
        i = np.broadcast_to(i, j.shape)
        at = np.flatnonzero((self.node[i] != self.node[j]) & (self.band[i] == self.band[j]) & (self.label[i] != self.label[j]) & (self.one_block[i] | (self.side[i] != self.side[j])))
        at = at[(self.bands[i[at]] == self.bands[j[at]]).argmax(1) == self.band[i[at]]]
        same = np.zeros(len(at), np.int64)
        for c, need in enumerate(self.least):
            cols = slice(c * STEP, (c + 1) * STEP)
            same += (self.sig[i[at], cols] == self.sig[j[at], cols]).sum(1)
            stays = same >= need
            at, same = at[stays], same[stays]
        return at


MEMBER = ["task", "node", "side", "band_no", "one_block", "label", "sig"]
_MEMBER_DDL = "task long, node long, side long, band_no int, one_block boolean, label long, sig binary"


def _pruned(threshold: float, tolerance: float):
    """Members of tasks, sorted by task -> those with a pair left."""
    least = prune_table(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            c = _Candidates(table, least)
            used, d = np.zeros(len(c.task), bool), 0
            while True:  # all pairs of rows that stand d apart
                d += 1
                i = np.flatnonzero(c.task[:-d] == c.task[d:])
                if not len(i):
                    break
                i = i[~(used[i] & used[i + d])]
                for lo in range(0, len(i), 1 << 16):
                    a = i[lo : lo + (1 << 16)]
                    a = a[c.left(a, a + d)]
                    used[a] = used[a + d] = True
            yield from table.filter(pa.array(used)).combine_chunks().to_batches()

    return run


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The shingle sets of some texts, as sorted numbers that stand for 128 bits and are the same for all of them."""
    first, second, sizes = [], [], []
    for _, _, data, offsets in chunks(texts):
        h, rows, starts, ends = words(data, offsets)
        s, of = shingles(h, rows)
        first.append(s)
        second.append(shingles(second_hashes(data, starts, ends), rows)[0])
        sizes.append(np.diff(of))
    if not sizes:
        return []
    ids, ends = identities(np.concatenate(first), np.concatenate(second)), np.cumsum(np.concatenate(sizes))
    return [np.unique(ids[end - n : end]) for end, n in zip(ends, np.concatenate(sizes), strict=True)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty ones have 0."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


class _Sets:
    """The shingle sets of one task."""

    def __init__(self, texts: pa.Array):
        self.sets = _sets(texts)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.flat = None

    def similar(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """The others whose similarity with i is at least threshold."""
        if len(others) < MANY:
            return others[[jaccard(self.sets[i], self.sets[j]) >= threshold for j in others.tolist()]]
        if self.flat is None:
            self.begin = np.append(0, np.cumsum(self.sizes))
            self.flat = np.concatenate(self.sets).astype(np.int32)
            self.mark = np.zeros(int(self.flat.max()) + 1, np.int32)
        mine = self.flat[self.begin[i] : self.begin[i + 1]]
        self.mark[mine] = 1
        size, out = self.sizes[others], []
        for lo in range(0, len(others), 512):
            n, at = size[lo : lo + 512], self.begin[others[lo : lo + 512]]
            ends = np.cumsum(n)
            both = np.add.reduceat(self.mark[self.flat[np.arange(ends[-1]) + np.repeat(at - ends + n, n)]], ends - n)
            out.append(both / (len(mine) + n - both) >= threshold)
        self.mark[mine] = 0
        return others[np.concatenate(out)]


def _verified(threshold: float, tolerance: float, counts: bool):
    """Members with n_texts and text, sorted by task -> node, root (a node that it is connected with), n_links of nodes with links.

    Without `counts` pairs that are connected already are passed over, and n_links is null.
    """
    least = prune_table(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            c = _Candidates(table, least)
            weight = table.column("n_texts").to_numpy()
            edges = np.flatnonzero(np.append(True, c.task[1:] != c.task[:-1])).tolist() + [len(c.task)]
            for lo, hi in zip(edges, edges[1:]):  # a task at a time, so that only its sets are held
                sets = _Sets(table.column("text").slice(lo, hi - lo).combine_chunks())
                links, group, linked = np.zeros(hi - lo, np.int64), np.arange(hi - lo), np.zeros(hi - lo, bool)
                for i in range(hi - lo - 1):
                    j = np.arange(i + 1, hi - lo)
                    if not counts:
                        j = j[group[j] != group[i]]
                    j = sets.similar(i, j[c.left(lo + i, lo + j)], threshold)
                    if len(j):
                        links[i] += weight[lo + j].sum()
                        links[j] += weight[lo + i]
                        linked[i] = linked[j] = True
                        group[np.isin(group, group[j])] = group[i]
                got = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(c.node[lo + got]), pa.array(c.node[lo + group[got]]), pa.array(links[got] if counts else [None] * len(got), pa.int64())], ["node", "root", "n_links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of edges (node, root), each row with node >= root or not; label: the smallest node.

    Every round takes the smallest label of the neighbours and then the label's own label, so that chains halve; it ends when
    a round changes nothing. Labels are written in the shared folder after each round.
    """
    with scratch(edges.sparkSession) as keep:
        both = materialise(edges.select("node", "root").unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct())
        labels = materialise(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("label")))
        while True:
            heard = both.join(labels, both["root"] == labels["node"]).select(both["node"], labels["label"])
            nearest = labels.unionByName(heard).groupBy("node").agg(F.min("label").alias("label"))
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
            jumped = materialise(nearest.join(up, "label", "left").select("node", F.least("label", "above").alias("label")))
            changed = jumped.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").limit(1).count()
            labels = jumped
            if not changed:
                return keep(labels)


def _dealt(members: DataFrame) -> DataFrame:
    """members (node, band_no, band, n_shingles) of bands with two nodes or more, with side and blocks."""
    shared = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("n > 1")
    shared = shared.select("band", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("blocks"))
    return members.join(shared, "band").withColumn("side", F.pmod(F.xxhash64("node", F.lit(7)), "blocks"))


def _within(dealt: DataFrame) -> DataFrame:
    """A task for each block."""
    return dealt.withColumns({"one_block": F.lit(True), "task": F.xxhash64("band", "side", "side")})


def _across(dealt: DataFrame) -> DataFrame:
    """A task for each pair of blocks."""
    other = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> side")
    return other.withColumns({"one_block": F.lit(False), "task": F.xxhash64("band", F.least("side", "other"), F.greatest("side", "other"))})


class _Join:
    def __init__(self, nodes: DataFrame, texts: DataFrame, threshold: float, tolerance: float, counts: bool):
        """nodes has node, sig, n_shingles, n_texts; texts has node, text (and may have more nodes)."""
        self.nodes, self.texts, self.threshold, self.tolerance, self.counts = nodes, texts, threshold, tolerance, counts

    def links(self, tasks: DataFrame) -> DataFrame:
        """(node, root, n_links) of tasks with task, node, side, band_no, one_block and, where some pairs are known, label."""
        label = F.col("label") if "label" in tasks.columns else F.col("node").alias("label")
        members = tasks.select("task", "node", "side", "band_no", "one_block", label).join(self.nodes.select("node", "sig"), "node").select(*MEMBER)
        members = members.repartition("task").sortWithinPartitions("task", "node")
        with scratch(tasks.sparkSession) as keep:
            left = materialise(map_texts(members, _pruned(self.threshold, self.tolerance), _MEMBER_DDL))
            wanted = left.select("node").distinct().join(self.nodes.select("node", "n_texts"), "node")
            texts = self.texts.join(wanted, "node").select("node", "text", "n_texts")
            found = left.join(texts, "node").repartition("task").sortWithinPartitions("task", "node")
            return keep(materialise(map_texts(found, _verified(self.threshold, self.tolerance, self.counts), "node long, root long, n_links long")))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(links, labels of their components)."""
        band = F.explode(F.array(*[F.struct(F.lit(b).alias("band_no"), F.xxhash64(F.substring("sig", 2 * BAND * b + 1, 2 * BAND), F.lit(b)).alias("band")) for b in range(BANDS)]))
        dealt = _dealt(self.nodes.select("node", "n_shingles", band.alias("b")).select("node", "n_shingles", "b.*"))
        if self.counts:
            links = self.links(_within(dealt).unionByName(_across(dealt).drop("other")))
            return links, components(links)
        links = self.links(_within(dealt))
        labels = components(links)
        large = materialise(dealt.where("blocks > 1"))
        if large.isEmpty():
            return links, labels
        known = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        leaders = _dealt(known.groupBy("band", "band_no", "label").agg(F.min(F.struct("node", "n_shingles")).alias("x")).select("band", "band_no", "x.*"))
        links = links.unionByName(self.links(_within(leaders).unionByName(_across(leaders).drop("other"))))
        labels = components(links)
        known = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        parted = known.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band")
        rest = materialise(known.join(parted, "band"))
        if rest.isEmpty():
            return links, labels
        links = links.unionByName(self.links(_across(rest)))
        return links, components(links)


def _classes(rows: DataFrame, threshold: float, tolerance: float, counts: bool) -> DataFrame:
    """(doc_id, text_id, class_id, text_class, n_links, is_kept) of rows (doc_id, text, text_id), one for each row."""
    with scratch(rows.sparkSession) as keep:
        signed, known = map(keep, _signed_and_known(rows, threshold, tolerance, counts))
    kept = (F.col("text_id") == F.col("first_text")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return signed.select("doc_id", "text_id").join(known, "text_id").select("doc_id", "text_id", "class_id", "text_class", "n_links", kept.alias("is_kept"))


def _signed_and_known(rows: DataFrame, threshold: float, tolerance: float, counts: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_id of every row, what is known of every text), both written."""
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_id"]]).add("n_shingles", "long").add("set_id", "binary").add("sig", "binary")
    signed = materialise(map_texts(rows.select("doc_id", "text_id", "text"), _sign(["doc_id", "text_id"]), schema))
    texts = materialise(signed.groupBy("text_id", "set_id").agg(F.min("doc_id").alias("text_class")))
    first = F.min(F.struct(F.col("text_class").isNull(), "text_class", "text_id")).alias("first")
    named = texts.where("set_id is not null").groupBy("set_id").agg(first, F.count("*").alias("n_texts"))
    sigs = signed.where("set_id is not null").select("set_id", "sig", "n_shingles").dropDuplicates(["set_id"])
    nodes = materialise(sigs.join(named, "set_id").withColumn("node", F.monotonically_increasing_id()))  # the written numbers count

    of_node = nodes.select("node", F.col("first.text_id").alias("text_id"), F.col("first.text_class").alias("doc_id"))
    found = rows.join(of_node, (rows["text_id"] == of_node["text_id"]) & rows["doc_id"].eqNullSafe(of_node["doc_id"])).select("node", "text").dropDuplicates(["node"])
    links, labels = _Join(nodes, found, threshold, tolerance, counts).run()

    linked = labels.join(links.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node").join(nodes.select("node", "first"), "node")
    classes = linked.groupBy("label").agg(F.min("first").alias("best"))
    of_linked = linked.join(classes, "label").select("node", "best", "n_links")
    of_set = nodes.join(of_linked, "node", "left").select("set_id", F.coalesce("best", "first").alias("best"), (F.col("n_texts") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    known = texts.join(of_set, "set_id", "left").select(
        "text_id",
        "text_class",
        F.when(F.col("best").isNull(), F.col("text_class")).otherwise(F.col("best.text_class")).alias("class_id"),
        F.coalesce("best.text_id", "text_id").alias("first_text"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    return signed, materialise(known)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("text_id", text_id("text"))


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id, text_class, n_links, is_kept.

    class_id is the smallest doc_id among all documents linked directly or through others, text_class the smallest among
    those with the same text, n_links the number of different texts that link to this one, and is_kept tells the document of
    a class to keep when duplicates go: the one with doc_id = class_id (every row of it, if its row is repeated).
    """
    return _classes(_rows(docs, doc_id, text), threshold, tolerance, counts=True).drop("text_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-9, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class: of its smallest id, and of rows with that id and text the one with the smallest hash of all columns."""
    classes = _classes(_rows(docs, doc_id, text), threshold, tolerance, counts=False)
    kept = classes.where("is_kept").groupBy("text_id", "doc_id").agg(F.count("*").alias("n_same"))
    held = docs.select(F.struct(*docs.columns).alias("row"), text_id(F.coalesce(F.col(text), F.lit(""))).alias("text_id"), F.col(doc_id).alias("doc_id"), F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)).alias("order"))
    both = held.alias("h").join(kept.alias("k"), (F.col("h.text_id") == F.col("k.text_id")) & F.col("h.doc_id").eqNullSafe(F.col("k.doc_id"))).select("row", "h.text_id", "order", "n_same")
    one = both.where("n_same > 1").groupBy("text_id").agg(F.min_by("row", "order").alias("row"))
    return both.where("n_same = 1").select("row").unionByName(one.select("row")).select("row.*")


#: near_duplicate_classes of all documents by joining shingles, for small tables.
ORACLE_SQL = r"""
with recursive texts as (
  select text, md5(text) as text_id, min(doc_id) as text_class from (select doc_id, coalesce(text, '') as text from documents) group by text
), worded as (
  select text_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), sets as (
  select text_id, list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from worded
), each_one as (
  select text_id, len(s) as n, unnest(s) as x from sets
), common as (
  select a.text_id as a, b.text_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as same from each_one a join each_one b on a.x = b.x and a.text_id <> b.text_id group by all
), links as (
  select a, b from common where same >= 0.8 * (n + m - same)
), counted as (
  select a as text_id, count(*) as n_links from links group by a
), reach as (
  select text_id, text_id as other from texts
  union
  select r.text_id, l.b from reach r join links l on r.other = l.a
), classes as (
  select r.text_id, arg_min(t.text_class, (t.text_class is null, coalesce(t.text_class, 0), t.text_id)) as class_id, arg_min(t.text_id, (t.text_class is null, coalesce(t.text_class, 0), t.text_id)) as first_text
  from reach r join texts t on r.other = t.text_id group by r.text_id
)
select d.doc_id, c.class_id, t.text_class, coalesce(n.n_links, 0)::bigint as n_links, c.first_text = t.text_id and d.doc_id is not distinct from c.class_id as is_kept
from documents d join texts t on coalesce(d.text, '') = t.text join classes c on c.text_id = t.text_id left join counted n on n.text_id = t.text_id
"""
