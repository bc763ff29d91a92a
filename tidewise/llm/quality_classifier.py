"""Operator 1: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of the whole text is encoded, a gated attention learned from the
document labels weighs the passages, and the weighted representation is scored:

    h = tanh(W x + b)    a = softmax(w . (tanh(V h) * sigmoid(U h)))    score = sigmoid(c . sum(a h) + d)

Features of a passage come from its bytes alone: shares of character classes, word lengths, repeated words and hashed words.
The model is fitted with numpy on the driver from at most `sample` labelled documents and `passage_cap_mb` of their features (a
documented bound). One row of each id counts, that with the smallest hash of its text. Ids are taken in the order of their hashes, and one
whose features no longer fit is passed over; sizes are computed from numbers of words before any features are. Scoring runs
in tasks over all documents.

Null and empty texts are one passage without words and get a score as well. Labels that are null, outside 0 and 1 or
contradictory for one id are left out. Without labels every score is 0.5; with one class only the model learns that class. A null id is never
held out. Repeated rows and further columns pass through; columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.shared import map_texts
from tidewise.llm.words import chunks, words

PASSAGE = 64
BUCKETS = 64
#: The words of words() in SQL.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Character classes of bytes.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",;:", "!?", "|", "#*$%&<>", "\"'()[]{}-/"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(_c) for _c in _chars]] = _k
_CLASS[0x80:] = len(_CLASSES) + 1
_N_CLASS = len(_CLASSES) + 2
DIMENSIONS = _N_CLASS + 6 + BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each row and the end); each row has one passage at least."""
    hashes, rows, starts, ends = words(data, offsets)
    n_words = np.diff(rows)
    count = np.maximum(1, -(-n_words // PASSAGE))
    bags = np.concatenate([[0], np.cumsum(count)])
    n = int(bags[-1])
    k = np.arange(n) - np.repeat(bags[:-1], count)
    first = np.repeat(rows[:-1], count) + k * PASSAGE  # the first word of each passage
    begin = np.where(k == 0, np.repeat(offsets[:-1], count), np.append(starts, len(data))[np.minimum(first, len(starts))])
    size = np.diff(np.append(begin, len(data)))
    by_class = np.bincount(np.repeat(np.arange(n) * _N_CLASS, size) + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
    passage_of = np.repeat(bags[:-1], n_words) + (np.arange(len(hashes)) - np.repeat(rows[:-1], n_words)) // PASSAGE
    in_passage = np.bincount(passage_of, minlength=n)
    length = np.bincount(passage_of, ends - starts, n)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage_of[1:] == passage_of[:-1])
    again = np.bincount(passage_of, same, n)
    order = np.lexsort((hashes, passage_of))
    h, p = hashes[order], passage_of[order]
    fresh = np.ones(len(h))
    fresh[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p, fresh, n)
    hashed = np.bincount(passage_of * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    w = np.maximum(in_passage, 1)
    letters = np.maximum(by_class[:, 0] + by_class[:, 1], 1)
    dense = [in_passage / PASSAGE, length / w / 10, again / w, distinct / w, by_class[:, 1] / letters, np.log1p(size) / 10]
    x = np.column_stack([by_class / np.maximum(size, 1)[:, None], *dense, np.sqrt(hashed / w[:, None])])
    return x.astype(np.float32), bags


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) * self.scale, bags)[-1]

    def _forward(self, x: np.ndarray, bags: np.ndarray):
        h = np.tanh(x @ self.W + self.b)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        e = (t * g) @ self.w
        count = np.diff(bags)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags[:-1]), count))
        a = e / np.repeat(np.add.reduceat(e, bags[:-1]), count)
        z = np.add.reduceat(h * a[:, None], bags[:-1])
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))


    def gradient(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of the bags, by every trained array; x is scaled already."""
        h, t, g, a, z, p = self._forward(x, bags)
        count = np.diff(bags)
        ds = (p - labels) / len(labels)
        dz = np.repeat(ds, count)[:, None] * self.c
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bags[:-1]), count))
        dtg = de[:, None] * self.w
        dv, du = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dv @ self.V.T + du @ self.U.T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}


_TRAINED = ("W", "b", "V", "U", "w", "c", "d")


def fit(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 16, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """Adam on the log loss of bags; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    zero = np.zeros(DIMENSIONS, np.float32)
    m = Model(zero, zero, draw(DIMENSIONS, hidden), np.zeros(hidden, np.float32), draw(hidden, attention), draw(hidden, attention), draw(attention), np.zeros(hidden, np.float32), np.zeros(1, np.float32))
    if not len(labels):
        return m
    m.mean, m.scale = x.mean(0), (1 / (x.std(0) + 1e-2)).astype(np.float32)
    x = (x - m.mean) * m.scale
    moment = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in _TRAINED}
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 128)):
            count = np.diff(bags)[batch]
            part = np.concatenate([[0], np.cumsum(count)])
            at = np.arange(part[-1]) + np.repeat(bags[batch] - part[:-1], count)
            grad = m.gradient(x[at], part, labels[batch])
            step += 1
            for k in _TRAINED:
                value, (first, second) = getattr(m, k), moment[k]
                d = (grad[k] + decay * value).astype(np.float32)
                first += 0.1 * (d - first)
                second += 0.001 * (d * d - second)
                value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return m


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the first row of each id."""
    seen: set[int] = set()
    for batch in batches:
        new = {}
        for i, d in enumerate(batch.column("doc_id").to_pylist()):
            if d not in seen:
                new.setdefault(d, i)
        seen.update(new)
        batch = batch.take(pa.array(list(new.values()), pa.int64()))
        for lo, hi, data, offsets in chunks(batch.column("text")):
            x, bags = passages(data, offsets)
            blobs = [x[bags[i] : bags[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("quality").slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["doc_id", "quality", "x"])


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def choose(docs: DataFrame, labels: DataFrame, sample: int, passage_cap_mb: int) -> pa.Table:
    """(doc_id, quality, text_hash) of the documents to learn from: at most `sample` rows of numbers, one for each id."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").where(~held_out()).select("doc_id", F.col("quality").cast("int"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known.orderBy(*by_hash).limit(sample)), "doc_id")
    size = F.greatest(F.lit(1), F.ceil(F.regexp_count("text", F.lit(WORD)) / PASSAGE)).cast("long") * 4 * DIMENSIONS
    one = rows.select("doc_id", "quality", F.struct(F.xxhash64("text").alias("text_hash"), size.alias("size")).alias("row")).groupBy("doc_id", "quality").agg(F.min("row").alias("row"))
    ranked = one.select("doc_id", "quality", "row.text_hash", "row.size").orderBy(*by_hash).limit(sample).toArrow()
    room, fits = passage_cap_mb << 20, []
    for n in ranked.column("size").to_pylist():
        fits.append(n <= room)
        room -= n * fits[-1]
    return ranked.filter(pa.array(fits, pa.bool_())).select(["doc_id", "quality", "text_hash"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, passage_cap_mb: int = 120) -> Model:
    """Learn from labels.quality of documents that are not held out, at most `sample` of them and `passage_cap_mb` of features.

    The bound on features is met before features are computed: in the order of the hash of their ids, documents that no longer fit are left out.
    """
    chosen = docs.sparkSession.createDataFrame(choose(docs, labels, sample, passage_cap_mb))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("text_hash"))
    got = map_texts(rows.select("doc_id", "quality", "text"), _featured, "doc_id long, quality int, x binary").dropDuplicates(["doc_id"]).toArrow().sort_by([("doc_id", "ascending")])
    xs = [np.frombuffer(b, np.float32).reshape(-1, DIMENSIONS) for b in got.column("x").to_pylist()]
    y = np.array(got.column("quality").to_pylist(), np.float32)
    bags = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    return fit(np.concatenate(xs) if xs else np.zeros((0, DIMENSIONS), np.float32), bags, y)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) with score and predicted (1 if score >= threshold)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    weights = [getattr(model, f.name) for f in fields(Model)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*weights)
        for batch in batches:
            scores = [model.score(*passages(data, offsets)) for _, _, data, offsets in chunks(batch.column(text))]
            s = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_texts(docs.select(*dict.fromkeys([*kept, text])), run, schema)
