"""Operator 4: media columns of telephony audio.

`store_media` puts payload bytes losslessly into WAV files of one of three codecs: 8-bit mu-law or A-law samples, or the
4-bit units of IMA ADPCM blocks. `read_media` parses stored files, gives the payload back, expands mu-law and A-law by
lookup tables, decodes ADPCM with numpy across all blocks of a batch at once, resamples to `target` samples a second and describes the sound. `store_pcm` writes the media
column, reads it back and writes the resampled PCM as a column, from which its length and digest are taken.

The target is a parameter, 4 kHz by default: every 16-bit sample is the mean of the two it stands for (a low-pass before the rate is halved). At 16 kHz the PCM is four to eight
times the text. Files of a chunk come out codec by codec, so that like sounds are compressed together.

Null and empty texts are stored as 64 zero bytes. A null or broken file has null results. Equal texts give equal files and
equal features. Repeated rows come out as often as they came in; columns `keep` pass through, those named like a result are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.shared import map_texts, materialise, scratch
from tidewise.llm.words import chunks

RATE, TARGET = 8000, 4000
#: WAV format tags.
CODECS = {7: "mulaw", 6: "alaw", 0x11: "ima_adpcm"}
_TAGS = {name: tag for tag, name in CODECS.items()}
UNIT = 64
#: Bytes of an ADPCM block: its header and one unit.
BLOCK = 4 + UNIT
_TOGETHER = 2 << 20
#: How whole sounds are written.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20)}

_b = np.arange(256)
_u = _b ^ 0xFF
_magnitude = ((((_u & 0x0F) << 3) + 0x84) << ((_u >> 4) & 7)) - 0x84
MULAW = np.where(_u & 0x80, -_magnitude, _magnitude).astype(np.int16)
_a = _b ^ 0x55
_e, _m = (_a >> 4) & 7, (_a & 0x0F) << 4
_magnitude = np.where(_e == 0, _m + 8, (_m + 0x108) << np.maximum(_e - 1, 0))
ALAW = np.where(_a & 0x80, _magnitude, -_magnitude).astype(np.int16)
#: Step sizes and index changes of IMA ADPCM.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def wav(payload: bytes, codec: str) -> bytes:
    """A mono 8 kHz file; for ADPCM each 64 payload bytes become a block that starts at predictor 0 and index 0."""
    if codec == "ima_adpcm":
        blocks = np.zeros((len(payload) // UNIT, BLOCK), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, per_block = blocks.tobytes(), BLOCK, 4, 1 + 2 * UNIT
    else:
        data, align, bits, per_block = payload, 1, 8, 0
    fmt = struct.pack("<HHIIHHHH", _TAGS[codec], 1, RATE, RATE if align == 1 else RATE * align // per_block, align, bits, 2, per_block)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = b"WAVE" + chunk(b"fmt ", fmt) + chunk(b"data", data)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(file: bytes | None) -> tuple[str, int, int, bytes] | None:
    """(codec, rate, block size, sound bytes) of a mono file of a known codec; None for anything else."""
    if file is None or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", file, at + 8)
        elif name == b"data":
            data = file[at + 8 : at + 8 + size]
            if fmt is None or fmt[0] not in CODECS or fmt[1] != 1 or not fmt[2] or len(data) != size:
                return None
            if fmt[0] == _TAGS["ima_adpcm"] and (fmt[4] <= 4 or size % fmt[4]):
                return None
            return CODECS[fmt[0]], fmt[2], fmt[4], data
        at += 8 + size + size % 2
    return None


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks x (1 + 2 x units)) of IMA ADPCM blocks (bytes): one pass over the units, all blocks at once."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    units = np.empty((blocks.shape[1] - 4, 2, len(blocks)), np.uint8)
    units[:, 0], units[:, 1] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    units = units.reshape(-1, len(blocks))
    out = np.empty((len(units) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, unit in enumerate(units, 1):
        step, size = STEPS[index], unit & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(unit & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[size], 0, 88)
        out[k] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, ends: np.ndarray, rate: int, target: int = TARGET) -> tuple[np.ndarray, np.ndarray]:
    """(samples, ends) at the target rate of sounds laid end to end; linear between neighbours, in integers, the last sample held.

    Before the rate goes down every sample becomes the mean of the ceil(rate / target) from it on.
    """
    full = np.diff(np.append(0, ends)) > 0
    last = ends[full] - 1

    def next_of(samples: np.ndarray) -> np.ndarray:
        following = np.append(samples[1:], samples[-1:])
        following[last] = samples[last]
        return following

    if target < rate:
        width, total, shifted = -(-rate // target), pcm.astype(np.int64), pcm
        for _ in range(width - 1):
            shifted = next_of(shifted)
            total = total + shifted
        pcm = (total // width).astype(np.int16)
    following = next_of(pcm)
    if 2 * rate == target:
        out = np.empty((len(pcm), 2), np.int16)
        out[:, 0] = pcm
        out[:, 1] = (pcm.astype(np.int32) + following) >> 1
        return out.reshape(-1), 2 * ends
    size = np.diff(np.append(0, ends))
    count = -(-size * target // rate)
    to = np.cumsum(count)
    at = (np.arange(to[-1] if len(to) else 0) - np.repeat(to - count, count)) * rate
    i, part = np.repeat(ends - size, count) + at // target, at % target
    return ((pcm[i].astype(np.int64) * (target - part) + following[i].astype(np.int64) * part) // target).astype(np.int16), to


def decode(files: list[bytes | None], target: int = TARGET) -> list[dict]:
    """codec, payload, pcm (int16 at the target rate) and feature of each file, Nones for a broken one."""
    out = [dict.fromkeys(("codec", "payload", "pcm", "feature")) for _ in files]
    groups: dict[tuple[str, int, int], list[tuple[int, bytes]]] = {}
    for n, file in enumerate(files):
        if (found := parse(file)) is not None:
            groups.setdefault(found[:3], []).append((n, found[3]))
    for (codec, rate, align), members in groups.items():
        data = np.frombuffer(b"".join(d for _, d in members), np.uint8)
        sizes = np.array([len(d) for _, d in members])
        if codec == "ima_adpcm":
            blocks = data.reshape(-1, align)
            pcm, sizes, payload = adpcm(blocks).reshape(-1), sizes // align * (2 * align - 7), blocks[:, 4:].tobytes()
            lengths = [len(d) // align * (align - 4) for _, d in members]
        else:
            pcm, payload, lengths = (MULAW if codec == "mulaw" else ALAW)[data], data.tobytes(), sizes.tolist()
        pcm, ends = resample(pcm, np.cumsum(sizes), rate, target)
        begins = np.append(0, ends[:-1])
        at = 0
        for (n, _), length, a, b in zip(members, lengths, begins.tolist(), ends.tolist(), strict=True):
            sound = pcm[a:b]
            out[n] = {"codec": codec, "payload": payload[at : at + length], "pcm": sound, "feature": feature(codec, sound)}
            at += length
    return out


def feature(codec: str, sound: np.ndarray) -> str:
    """codec:samples:peak:root mean square:zero crossings:crc32 of the samples."""
    if not len(sound):
        return f"{codec}:0:0:0:0:0"
    wide = sound.astype(np.float32)
    power = float(np.dot(wide, wide)) / len(wide)
    negative = sound < 0
    return f"{codec}:{len(sound)}:{max(int(sound.max()), -int(sound.min()))}:{power**0.5:.1f}:{int((negative[1:] != negative[:-1]).sum())}:{zlib.crc32(sound.astype('<i2').tobytes()):08x}"


def store_media(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with n_bytes (of the text as UTF-8), codec and media (the file); the codec follows from the payload's crc32."""
    names = ["n_bytes", "codec", "media"]
    keep = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice = list(CODECS.values())
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(text), _TOGETHER):
                sizes, codecs, files = np.diff(offsets), [], []
                whole = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    payload = whole[a:b] + bytes(UNIT * max(1, -(-(b - a) // UNIT)) - (b - a))
                    codecs.append(choice[zlib.crc32(payload) % len(choice)])
                    files.append(wav(payload, codecs[-1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(sizes, pa.int64()), pa.array(codecs), pa.array(files, pa.binary())], [*keep, *names])

    schema = [*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("media", T.BinaryType())]
    return map_texts(docs.select(*dict.fromkeys([*keep, text])), run, T.StructType(schema))


def read_media(df: DataFrame, keep: list[str], media: str = "media", pcm: bool = True, target: int = TARGET) -> DataFrame:
    """The columns `keep` with codec, payload, feature and, if asked for, pcm (16-bit little-endian samples at the target rate)."""
    names = ["codec", "payload", "feature", *["pcm"] * pcm]
    keep = [c for c in keep if c not in names]
    types = {"codec": pa.string(), "payload": pa.binary(), "feature": pa.string(), "pcm": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column(media), _TOGETHER):
                part = batch.slice(lo, hi - lo)
                found = decode(part.column(media).to_pylist(), target)
                order = sorted(range(hi - lo), key=lambda i: found[i]["codec"] or "")
                found = [found[i] for i in order]
                for x in found:
                    x["pcm"] = None if x["pcm"] is None or not pcm else x["pcm"].astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(order)) for c in keep), *(pa.array([x[c] for x in found], types[c]) for c in names)], [*keep, *names])

    schema = [*(df.schema[c] for c in keep), *(T.StructField(c, T.StringType() if types[c] == pa.string() else T.BinaryType()) for c in names)]
    return map_texts(df.select(*dict.fromkeys([*keep, media])), run, T.StructType(schema))


def store_pcm(docs: DataFrame, keep: list[str], text: str = "text", target: int = TARGET) -> DataFrame:
    """The columns `keep` of docs with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, codec, feature and pcm, written and read back.

    The media column is written first, and all else comes from what is read of it; it goes when the PCM is written.
    """
    with scratch(docs.sparkSession) as keep_table:
        stored = materialise(store_media(docs, keep, text).drop("codec"), **PACKED)
        of_media = ["n_bytes", "media_bytes", "media_sha256"]
        keep = [c for c in keep if c not in ("n_bytes", "codec", "media")]
        stored = stored.select(*keep, "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
        read = read_media(stored, [*keep, *of_media], target=target)
        payload = {"payload_bytes": F.length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256), "tail_crc32": F.crc32(F.substring("payload", -64, 64))}
        return keep_table(materialise(read.withColumns(payload).drop("payload"), **PACKED))


#: Sizes and digest of the payloads, without the files.
PAYLOAD_SQL = """
with docs as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) as n from documents)
select doc_id, n::bigint as n_bytes, (64 * greatest(1, (n + 63) // 64))::bigint as payload_bytes, sha256(text || repeat(chr(0), (64 * greatest(1, (n + 63) // 64) - n)::int)) as payload_sha256 from docs
"""
