"""Operator 7: materialise token sequences in training order.

Texts become token ids (with the tiktoken library and a public rank file), each followed by the end-of-text id. The texts that one
partition reads form a stream that is cut into sequences of `length` ids; the last one is filled up with the end-of-text id.
Sequences are numbered 0 to N - 1, and a keyed Feistel permutation over the next power of four, walked until it
falls below N, gives each its slot. Ranges of slots are shards, whose files hold records of one fixed size, so that slot s
is at byte (s mod per shard) * stride of its shard, and a reader can begin anywhere.

The streams are written once in the shared folder, compressed, with the partition that wrote them and a running number, so
numbering needs one row per partition, not a sort. What a block of a stream sends to one shard travels as one
compressed row. Shards are dealt to `most_parts` range partitions at most, each of which writes its run of shards one after the
other from its sorted rows, so neither the number of shuffle partitions nor the memory of a task grows with the input. A shard is
written under a name of its task attempt and then renamed, and its bytes follow from the streams, so tasks can be repeated. The
manifest comes last.

The order is a function of the key, of the number of sequences and of how the input is split into partitions: the same files read
with the same split sizes give the same bytes, and another split size cuts other sequences. The streams are what fixes it.

Ids are stored in 16 bits where the vocabulary allows it, else in 32. Null and empty texts are an end-of-text id. Null ids stay null in
the index, which keeps their type; repeated rows are separate texts; other columns are not read. An empty table gives a manifest
without slots and no shards.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewise.llm.shared import map_texts, materialise
from tidewise.llm.words import chunks, mix

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
ROUNDS = 6


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the numbers index, a permutation of range(n) for every key."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


@lru_cache(maxsize=1)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Sequences of a compressed block of a stream.
BLOCK = 8192


def id_type(end: int) -> str:
    """The numpy type of ids up to end."""
    return "<u2" if end <= 0xFFFF else "<u4"


def _streams(path: str, pattern: str, length: int, doc: pa.DataType):
    """Batches of (doc_id, text) -> blocks: part, first (number of the first sequence), n, ids, and the texts' pieces in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part = _encoding(path, pattern), TaskContext.get().partitionId()
        encode, end, pack = encoding.encode_ordinary, encoding.n_vocab, zstandard.ZstdCompressor(level=9)
        kind, schema = id_type(end), _block_schema(doc)
        stream, pieces, held, first = [], [], 0, 0

        def block(n: int) -> pa.RecordBatch:
            """The next n sequences as a row; what is left stays in stream and pieces."""
            nonlocal stream, pieces, held, first
            flat, size = np.concatenate(stream), n * length
            now = [(d, at, start, min(k, size - start)) for d, at, start, k in pieces if start < size]
            rest = [(d, at + max(0, size - start), max(0, start - size), k - max(0, size - start)) for d, at, start, k in pieces if start + k > size]
            row = {"part": part, "first": first, "n": n, "ids": pack.compress(flat[:size].tobytes()), "doc": [x[0] for x in now], "at": [x[1] for x in now], "start": [x[2] for x in now], "size": [x[3] for x in now]}
            stream, pieces, held, first = [flat[size:]], rest, held - size, first + n
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, _, _ in chunks(batch.column("text"), 1 << 20):
                for i, text in enumerate(batch.column("text").slice(lo, hi - lo).to_pylist(), lo):
                    tokens = np.array([*encode(text or ""), end], kind)
                    pieces.append((ids[i], 0, held, len(tokens)))
                    stream.append(tokens)
                    held += len(tokens)
                while held >= BLOCK * length:
                    yield block(BLOCK)
        if held:
            stream.append(np.full(-held % length, end, kind))
            held += len(stream[-1])
            yield block(held // length)

    return run


def _block_schema(doc: pa.DataType) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("doc", pa.list_(doc)), *((c, pa.list_(pa.int64())) for c in ("at", "start", "size"))])


def _dealt(length: int, total: int, key: int, per_shard: int, kind: str):
    """Blocks (first, n, ids) -> (shard, places, records): what a block has for each shard, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            for first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("first", "n", "ids")), strict=True):
                records = np.frombuffer(unpack.decompress(ids), kind).reshape(n, length)
                slot = permute(np.arange(first, first + n), total, key)
                order = np.argsort(slot)
                shard, place = slot[order] // per_shard, (slot[order] % per_shard).astype("<i4")
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), n]
                rows = [(int(shard[a]), place[a:b].tobytes(), pack.compress(records[order[a:b]].tobytes())) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["shard", "places", "records"])

    return run


def _indexed(length: int, total: int, key: int, per_shard: int, kind: str, doc: pa.DataType):
    """Blocks without ids -> the index row of every sequence."""
    texts, stride = pa.list_(pa.struct([("doc_id", doc), ("at", pa.int64()), ("n", pa.int64())])), np.dtype(kind).itemsize * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, docs, ats, starts, sizes in zip(*(batch.column(c).to_pylist() for c in ("first", "n", "doc", "at", "start", "size")), strict=True):
                held: list[list[dict]] = [[] for _ in range(n)]
                for doc, at, start, size in zip(docs, ats, starts, sizes, strict=True):
                    while size:
                        k, within = divmod(start, length)
                        here = min(size, length - within)
                        held[k].append({"doc_id": doc, "at": at, "n": here})
                        at, start, size = at + here, start + here, size - here
                slot = permute(np.arange(first, first + n), total, key)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * stride), pa.array(held, texts)], ["slot", "shard", "offset", "texts"])

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(folder: str, length: int, total: int, per_shard: int, kind: str):
    """Rows of _dealt sorted by shard -> (shard, shard_crc32), with the shard's file written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        unpack, now, whole = zstandard.ZstdDecompressor(), None, None

        def close() -> pa.RecordBatch:
            name, data = f"{root}/_{uuid.uuid4().hex}", memoryview(whole).cast("B")
            with files.open_output_stream(name) as out:
                out.write(data)
            files.move(name, f"{root}/{shard_name(now)}")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([zlib.crc32(data)], pa.int64())], ["shard", "shard_crc32"])

        for batch in batches:
            for shard, places, records in zip(*(batch.column(c).to_pylist() for c in ("shard", "places", "records")), strict=True):
                if shard != now:
                    if now is not None:
                        yield close()
                    now, whole = shard, np.zeros((min(per_shard, total - shard * per_shard), length), kind)
                whole[np.frombuffer(places, "<i4")] = np.frombuffer(unpack.decompress(records), kind).reshape(-1, length)
        if now is not None:
            yield close()

    return run


def write_training_order(
    docs: DataFrame, folder: str, length: int = 512, key: int = 2024, per_shard: int = 1 << 14, most_shards: int = 1 << 17, most_parts: int = 4096, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Write the shards and manifest.json into folder (a URI that all executors reach) and return the index.

    Index, one row per sequence: slot, shard, offset (byte in the shard), texts (array of doc_id, at: first id of the text's
    piece, n: its ids with the end-of-text id), shard_crc32. Shards grow beyond `per_shard` slots where there would be
    more than `most_shards` (100 TB of text make shards of some hundreds of MB); a task holds one shard at a time.
    """
    end = _encoding(path, pattern).n_vocab  # the first id that is free
    kind, doc = id_type(end), docs.schema["doc_id"].dataType
    arrow_doc = to_arrow_type(doc)
    stored = T.StructType().add("part", "long").add("first", "long").add("n", "long").add("ids", "binary").add("doc", T.ArrayType(doc))
    for c in ("at", "start", "size"):
        stored.add(c, T.ArrayType(T.LongType()))
    blocks = materialise(map_texts(docs.select("doc_id", "text"), _streams(path, pattern, length, arrow_doc), stored))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("size"))
    parts = materialise(parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), "size"))
    total = parts.agg(F.sum("size")).first()[0] or 0
    per_shard = max(per_shard, -(-total // most_shards))
    shards = max(1, -(-total // per_shard))
    ranges = min(shards, most_parts)
    numbered = blocks.join(parts.drop("size"), "part").withColumn("first", F.col("before") + F.col("first"))
    files, root = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    dealt = numbered.select("first", "n", "ids").mapInArrow(_dealt(length, total, key, per_shard, kind), "shard long, places binary, records binary")
    dealt = dealt.repartitionById(ranges, F.floor(F.col("shard") * ranges / shards).cast("int")).sortWithinPartitions("shard")
    written = materialise(dealt.mapInArrow(_write(folder, length, total, per_shard, kind), "shard long, shard_crc32 long"))
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"slots": total, "length": length, "dtype": kind, "end": end, "per_shard": per_shard, "key": key}).encode())
    texts = T.ArrayType(T.StructType().add("doc_id", doc).add("at", "long").add("n", "long"))
    index = numbered.select("first", "n", "doc", "at", "start", "size").mapInArrow(_indexed(length, total, key, per_shard, kind, arrow_doc), T.StructType().add("slot", "long").add("shard", "long").add("offset", "long").add("texts", texts))
    return index.join(written, "shard").select("slot", "shard", "offset", "texts", "shard_crc32")


def read_slots(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Sequences of the slots start to stop - 1 in training order, read one after the other from any slot on."""
    files, root = pa.fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    stride, slot = np.dtype(m["dtype"]).itemsize * m["length"], start
    stop = m["slots"] if stop is None else min(stop, m["slots"])
    while slot < stop:
        shard, within = divmod(slot, m["per_shard"])
        with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(within * stride)
            for _ in range(min(m["per_shard"] - within, stop - slot)):
                yield np.frombuffer(f.read(stride), m["dtype"])
                slot += 1
