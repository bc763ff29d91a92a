"""Words of a column of texts, found and hashed with numpy over the UTF-8 bytes of an Arrow batch.

A word is a longest run of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased: ASCII letters, digits, and any
character beyond ASCII. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes worked on at a time; only a longer single text goes beyond.
CHUNK = 1 << 20

_FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 0x80:
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c
#: Longer words are hashed by xxhash.
_LONG = 64
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column: row i is bytes[offsets[i]:offsets[i + 1]]."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    _, ends, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about limit bytes; every row comes once."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of each word, by its folded bytes; a second seed gives other, independent bits.

    Eight bytes at a time go through `mix`, a bijection, so words of up to eight bytes differ for certain.
    """
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    eight = np.lib.stride_tricks.as_strided(np.append(folded, np.zeros(8, np.uint8)), (len(folded) + 1, 8), (1, 1))
    at = np.flatnonzero(size <= _LONG)
    h = np.full(len(at), _SEEDS[seed], np.uint64)
    for k in range(0, _LONG, 8):
        left = size[at] - k
        block = np.ascontiguousarray(eight[starts[at] + k]).view("<u8")[:, 0]
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        h = mix(h ^ block)
        more = left > 8
        out[at[~more]] = h[~more]
        at, h = at[more], h[more] * np.uint64(_SEEDS[1 - seed] | 1)
        if not len(at):
            break
    whole = folded.tobytes() if (size > _LONG).any() else b""
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]], seed=_SEEDS[seed])
    return out


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another 64 bits of the words that words() has found."""
    return hashed(_FOLD[data], starts, ends, 1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end, byte starts, byte ends) for the rows of a chunk."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = _FOLD[data]
    inside = folded != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hashed(folded, starts, ends), np.searchsorted(starts, offsets), starts, ends


def hash_word(word: bytes) -> int:
    """What words() gives for one word."""
    data = np.frombuffer(word, np.uint8)
    return int(words(data, np.array([0, len(data)]))[0][0])


def identities(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers from 0 on that are equal where both hashes are: 128 bits for each value, sorted by the first."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    out = np.zeros(len(first), np.int64)
    out[order[1:]] = np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of k words, first run of each row and the end); a row of 1 to k - 1 words has one run of all its words."""
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_rows = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(out_rows[-1]) - np.repeat(out_rows[:-1] - rows[:-1], count)
    width = np.repeat(np.minimum(n, k), count)
    h = np.zeros(len(start), np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(j < width, padded[start + j] | np.uint64(1), np.uint64(0))
    return mix(h), out_rows
