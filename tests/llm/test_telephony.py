import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from tidewise.llm.queries import op4_telephony_audio, telephony_pcm
from tidewise.llm.telephony import ALAW, BLOCK, CODECS, MULAW, STEPS, adpcm, decode, parse, read_media, resample, store_media, wav


def slow_adpcm(block):
    """One block, one unit at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for unit in (byte & 15, byte >> 4):
            step = int(STEPS[index])
            change = step >> 3
            change += step if unit & 4 else 0
            change += step >> 1 if unit & 2 else 0
            change += step >> 2 if unit & 1 else 0
            value = max(-32768, min(32767, value - change if unit & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[unit & 7]))
            out.append(value)
    return out


def test_tables():
    assert MULAW[0xFF] == 0 and MULAW[0x00] == -32124 and MULAW[0x80] == 32124 and MULAW[0x7F] == 0
    assert ALAW[0xD5] == 8 and ALAW[0x55] == -8 and ALAW[0xAA] == 32256 and ALAW[0x2A] == -32256
    assert len(STEPS) == 89 and (np.diff(STEPS) > 0).all()


def test_adpcm_equals_one_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (50, BLOCK)).astype(np.uint8)
    assert adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("codec", CODECS.values())
def test_round_trip(codec):
    payloads = [random.Random(i).randbytes(64 * n) for i, n in enumerate((1, 2, 7))]
    got = decode([wav(p, codec) for p in payloads])
    assert [g["payload"] for g in got] == payloads and {g["codec"] for g in got} == {codec}
    assert [len(g["pcm"]) for g in got] == [-(-(129 if codec == "ima_adpcm" else 64) * n // 2) for n in (1, 2, 7)]
    assert [len(g["pcm"]) for g in decode([wav(p, codec) for p in payloads], 16_000)] == [(258 if codec == "ima_adpcm" else 128) * n for n in (1, 2, 7)]


def test_resample():
    pcm, ends = resample(np.array([0, 10, -20, 7], np.int16), np.array([3, 3, 4]), 8000, 16000)
    assert pcm.tolist() == [0, 5, 10, -5, -20, -20, 7, 7] and ends.tolist() == [6, 6, 8]
    pcm, ends = resample(np.array([0, 30, 60, 9], np.int16), np.array([3, 4]), 8000, 12000)
    assert pcm.tolist() == [0, 20, 40, 60, 60, 9, 9] and ends.tolist() == [5, 7]
    pcm, ends = resample(np.array([0, 10, -20, 7, 8, -3], np.int16), np.array([3, 3, 5, 6]), 8000, 4000)
    assert pcm.tolist() == [5, -20, 7, -3] and ends.tolist() == [2, 2, 3, 4]
    pcm, ends = resample(np.array([9, 0, 30, 60, 9, 3], np.int16), np.array([6]), 8000, 3000)
    assert pcm.tolist() == [13, 27, 3] and ends.tolist() == [3]  # means 13, 30, 33, 24, 5, 3 at 0, 2 2/3 and 5 1/3


def test_broken_files():
    good = wav(bytes(64), "alaw")
    assert parse(good) and [x["feature"] for x in decode([None, b"", b"RIFFxxxxWAVE", good[:-1], good])][:4] == [None] * 4


def test_frame(spark):
    df = spark.createDataFrame([(1, "é" * 40, 5), (1, "é" * 40, 5), (None, None, None), (2, "", 1), (3, "x" * 100_000, 0)], "doc_id long, text string, codec int")
    stored = store_media(df, ["doc_id", "codec"])
    assert stored.columns == ["doc_id", "n_bytes", "codec", "media"]
    got = sorted(read_media(stored, ["doc_id", "n_bytes"]).collect(), key=lambda r: (r.n_bytes in (0, 100_000), r.n_bytes == 100_000))
    assert [r.n_bytes for r in got] == [80, 80, 0, 0, 100_000]
    assert bytes(got[0].payload) == ("é" * 40).encode() + bytes(48) and got[0].feature == got[1].feature
    assert bytes(got[2].payload) == bytes(64) and got[2].feature == got[3].feature and len(got[4].payload) == 100_032
    assert read_media(store_media(df.limit(0), ["doc_id"]), ["doc_id"], pcm=False).count() == 0
    assert zlib.crc32(got[0].pcm) == int(got[0].feature.rpartition(":")[2], 16)


@pytest.mark.parametrize("query", [op4_telephony_audio, telephony_pcm])
def test_features_and_stored_pcm_against_one_sample_at_a_time(spark, tmp_path, query):
    """Peak, power, zero crossings and the bytes of the query's stored sound, from sample loops."""
    rows = [(1, "some text, some sound é" * 9, "en", "s", 1), (2, None, None, None, None), (3, "zz", "en", "s", 2), (4, "other words of a document " * 30, "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    expand = {"mulaw": lambda d: [mulaw(b) for b in d], "alaw": lambda d: [int(ALAW[b]) for b in d], "ima_adpcm": lambda d: [v for i in range(0, len(d), BLOCK) for v in slow_adpcm(d[i : i + BLOCK])]}
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (dict((i, t) for i, t, *_ in rows)[r.doc_id] or "").encode()
        payload = text + bytes(64 * max(1, -(-len(text) // 64)) - len(text))
        file = wav(payload, r.codec)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        pcm = expand[r.codec](parse(file)[3])
        out = [v for a, b in zip(pcm, pcm[1:] + pcm[-1:]) for v in (a, (a + b) >> 1)]
        if query is op4_telephony_audio:
            out = [(a + b) >> 1 for a, b in zip(pcm[::2], pcm[1::2] + pcm[-1:] * (len(pcm) % 2))]
        peak, power = max(abs(v) for v in out), math.sqrt(sum(v * v for v in out) / len(out))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))
        blob = struct.pack(f"<{len(out)}h", *out)
        codec, n, got_peak, got_power, got_crossings, crc = r.feature.split(":")
        assert (codec, int(n), int(got_peak), int(got_crossings), int(crc, 16)) == (r.codec, len(out), peak, crossings, zlib.crc32(blob)) and abs(float(got_power) - power) < 0.2
        assert (r.pcm_bytes, r.pcm_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())


def mulaw(byte):
    """One byte by the bits of G.711."""
    u = ~byte & 0xFF
    value = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return -value if u & 0x80 else value
