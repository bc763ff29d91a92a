"""Operator 8: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Within a pre-token the adjacent pairs wait in buckets, one for each merge rank, that hold positions in a linked list of
parts. Three levels of 64-bit words mark the buckets in use, so find-first-set on three words gives the lowest rank; a
position whose pair has changed since is skipped. A merge costs a constant number of such steps, so a pre-token of n bytes
takes about n of them, however long it is.

Null texts count as empty and give no ids. Pre-tokens are encoded separately; special tokens are ordinary text. Ids are
stored as little-endian unsigned 32-bit integers in a binary column. All input columns are kept; the new columns replace
columns with their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewise.llm.shared import map_texts
from tidewise.llm.words import chunks

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Encoded pre-tokens of at most KEPT_CHARS characters that a Python worker remembers, in each of two generations: some tens of MB.
REMEMBERED, KEPT_CHARS = 150_000, 32
#: Bytes of a column worked on together.
TOGETHER = 2 << 20


class RankQueue:
    """Items by rank; pop_rank() gives the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.bits = [0] * ((ranks >> 6) + 1)
        self.words = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, item) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [item]
            i = rank >> 6
            self.bits[i] |= 1 << (rank & 63)
            self.words[i >> 6] |= 1 << (i & 63)
            self.top |= 1 << (i >> 6)
        else:
            bucket.append(item)

    def pop_rank(self) -> tuple[int, list]:
        """The lowest rank and its items as they came, which leave the queue; (-1, []) if there are none."""
        if not self.top:
            return -1, []
        t = (self.top & -self.top).bit_length() - 1
        w = self.words[t]
        i = t << 6 | (w & -w).bit_length() - 1
        b = self.bits[i]
        low = b & -b
        rank = i << 6 | low.bit_length() - 1
        self.bits[i] = b = b ^ low
        if not b:
            self.words[t] = w = w & (w - 1)
            if not w:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """One vocabulary file; `cache` and `old` map pre-tokens to the bytes of their ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(len(self.tokens))
        #: (left id, right id) as one number, ascending, and the rank of the merged token
        pairs = np.array(sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks), np.int64).reshape(-1, 2)
        self.keys = np.append(pairs[:, 0], np.iinfo(np.int64).max)
        self.of_keys = np.append(pairs[:, 1], -1)
        self.singles = np.array(self.single, np.int64)
        self.cache, self.old = {}, {}

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.of_keys.tolist(), strict=True))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: always the lowest rank first, the leftmost of equal ones."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        pairs, queue = self.pairs.get, self.queue
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [-1] * n  # the rank that the pair starting here waits with
        for i in range(n - 1):
            if (rank := pairs(ids[i] << 32 | ids[i + 1])) is not None:
                now[i] = rank
                queue.push(rank, i)
        while True:
            rank, positions = queue.pop_rank()
            if rank < 0:
                break
            positions.sort()
            for k, i in enumerate(positions):
                if now[i] != rank:
                    continue  # stale
                j = after[i]
                ids[i] = rank
                after[i] = end = after[j]
                now[i] = now[j] = ids[j] = -1
                lower = False
                if end < n:
                    before[end] = i
                    if (new := pairs(rank << 32 | ids[end])) is not None:
                        now[i] = new
                        queue.push(new, i)
                        lower = new < rank
                if (p := before[i]) >= 0:
                    new = pairs(ids[p] << 32 | rank)
                    now[p] = -1 if new is None else new
                    if new is not None:
                        queue.push(new, p)
                        lower = lower or new < rank
                if lower:  # a lower rank has come up: the rest waits
                    for x in positions[k + 1 :]:
                        queue.push(rank, x)
                    break
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where they don't merge or one is -1."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (right >= 0), self.of_keys[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens, which share one queue: its items are arrays of positions, merged together for each rank."""
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        ids = np.append(self.singles[np.frombuffer(b"".join(pieces), np.uint8)], -1)  # the part after the last, at n, is none
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[first + lengths - 1] = n
        before[first] = n
        now = self._ranks(ids, ids[np.minimum(after, n)])
        queue, odd = RankQueue(len(self.tokens)), []

        def push(ranks: np.ndarray, positions: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = [*(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            lo = int(np.searchsorted(ranks, 0))
            for hi in cuts:
                if hi > lo:
                    queue.push(int(ranks[lo]), positions[lo:hi])
                    lo = hi

        push(now[:n], np.arange(n))
        while True:
            rank, items = queue.pop_rank()
            if rank < 0:
                break
            at = np.unique(np.concatenate(items)) if len(items) > 1 else items[0]
            at = at[now[at] == rank]  # the others are stale
            if not len(at):
                continue
            gone = after[at]
            if (linked := at[1:] == gone[:-1]).any():  # of overlapping pairs, the leftmost and then every other
                k = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(False, linked), 0, k))
                taken = (k - run) % 2 == 0
                at, gone = at[taken], gone[taken]
            end, prior = after[gone], before[at]
            neighbour = ids[end]
            right = self._ranks(np.full(len(at), rank), neighbour)
            ids[at], after[at], before[end] = rank, end, at
            ids[gone] = now[gone] = -1
            ids[n] = -1
            lower = (right >= 0) & (right < rank)
            if (changed := ids[end] != neighbour).any():
                right[changed] = self._ranks(np.full(int(changed.sum()), rank), ids[end[changed]])
            now[at] = right
            has = prior < n
            at_left = prior[has]
            left = self._ranks(ids[at_left], np.full(len(at_left), rank))
            now[at_left] = left
            lower[has] |= (left >= 0) & (left < rank)
            if lower.any():
                odd.append(at[lower])
            push(np.concatenate([right, left]), np.concatenate([at, at_left]))
        alive = ids[:n] >= 0
        blob = ids[:n][alive].astype("<u4").tobytes()
        ends = np.cumsum(np.add.reduceat(alive, first)) * 4
        out = [blob[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        if odd:  # where a merge brought up a lower rank, the order of merges matters: one at a time
            for i in np.unique(np.searchsorted(first, np.concatenate(odd), "right") - 1).tolist():
                out[i] = np.array(self.merge(pieces[i]), "<u4").tobytes()
        return out

    def _merge_in_parts(self, pieces: list[bytes]) -> list[bytes]:
        """merge_many over parts of about TOGETHER bytes, whatever the number of pieces."""
        out, part, size = [], [], 0
        for piece in pieces:
            part.append(piece)
            size += len(piece)
            if size >= TOGETHER:
                out += self.merge_many(part)
                part, size = [], 0
        return out + self.merge_many(part)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The bytes of the ids of each text. Short pre-tokens are remembered in two generations of bounded size, longer ones only for these texts."""
        split = list(map(self.split, texts))
        every = set().union(*split)
        long = [t for t in every if len(t) > KEPT_CHARS]
        every.difference_update(long)
        new = every - self.cache.keys()
        if len(self.cache) + len(new) > REMEMBERED:
            self.old, self.cache = self.cache, {}
            new = every
        again = new & self.old.keys()
        self.cache.update((t, self.old[t]) for t in again)
        fresh = list(new - again)
        merged = self._merge_in_parts([t.encode() for t in (*fresh, *long)])
        self.cache.update(zip(fresh, merged))
        if not long:
            return [b"".join(map(self.cache.__getitem__, tokens)) for tokens in split]
        of_long = dict(zip(long, merged[len(fresh) :], strict=True))
        return [b"".join([self.cache[t] if len(t) <= KEPT_CHARS else of_long[t] for t in tokens]) for tokens in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    return Encoder(path, pattern)


def _with_binary(df: DataFrame, of: str, names: list[str], make) -> DataFrame:
    """df with the binary columns make(values) of the values of column `of`; columns of those names are replaced."""
    df = df.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column(of), TOGETHER):
                part = batch.slice(lo, hi - lo)
                made = make(part.column(of).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.binary()) for x in made)], [*part.schema.names, *names])

    return map_texts(df, run, T.StructType([*df.schema.fields, *(T.StructField(c, T.BinaryType()) for c in names)]))


def encode_bpe(docs: DataFrame, text: str = "text", to: str = "ids", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with the ids of each whole text."""
    return _with_binary(docs, text, [to], lambda texts: [encoder(path, pattern).encode_all([t or "" for t in texts])])


def decode_bpe(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the bytes that the ids stand for; null ids count as none."""
    return _with_binary(df, ids, [to], lambda coded: [[encoder(path, pattern).decode(x or b"") for x in coded]])


def round_trip_bpe(docs: DataFrame, text: str = "text", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ids and decoded, the bytes that the ids decode to, in one pass of one Python worker."""

    def make(texts: list[str | None]) -> list[list[bytes]]:
        coder = encoder(path, pattern)
        ids = coder.encode_all([t or "" for t in texts])
        return [ids, [coder.decode(x) for x in ids]]

    return _with_binary(docs, text, ["ids", "decoded"], make)
