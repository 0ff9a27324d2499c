from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import telephony as T
from tests.llm import fixtures


def encode_adpcm(samples, block):
    """A plain encoder, sample by sample, for round trips."""
    per, out = (block - 4) * 2 + 1, b""
    for at in range(0, len(samples), per):
        part = samples[at : at + per]
        value, index, nibbles = int(part[0]), 0, []
        head = int(value).to_bytes(2, "little", signed=True) + bytes([index, 0])
        for s in part[1:]:
            step = T.STEPS[index]
            diff, n = int(s) - value, 0
            if diff < 0:
                n, diff = 8, -diff
            change = step >> 3
            for bit, size in ((4, step), (2, step >> 1), (1, step >> 2)):
                if diff >= size:
                    n, diff, change = n | bit, diff - size, change + size
            value = max(-32768, min(32767, value - change if n & 8 else value + change))
            index = max(0, min(88, index + (T.INDEX_MOVES * 2)[n]))
            nibbles.append((n, value))
        out += head + bytes(a[0] | b[0] << 4 for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
        yield [int(part[0]), *(v for _, v in nibbles)], out


def test_tables_follow_the_definitions():
    mu, a = T.mu_law_table(), T.a_law_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_adpcm_blocks():
    sound = (np.sin(np.arange(505 * 3) / 9) * 12000).astype(np.int16)
    want, data = [], b""
    for values, data in encode_adpcm(sound, 256):
        want += values
    got, rate = T.decode(T.wave(data, T.IMA_ADPCM, block=256))
    assert rate == 8000 and got.tolist() == want
    assert np.abs(got[50:].astype(int) - sound[50:]).mean() < 900


def test_a_shorter_last_block():
    sound = (np.sin(np.arange(505 * 2 + 101) / 9) * 12000).astype(np.int16)
    want, data = [], b""
    for values, data in encode_adpcm(sound, 256):
        want += values
    assert len(data) % 256
    assert T.decode(T.wave(data, T.IMA_ADPCM, block=256))[0].tolist() == want
    assert T.decode(T.wave(data[:512] + b"abc", T.IMA_ADPCM, block=256))[0].tolist() == want[:1010]


def test_sounds_decoded_together_and_in_chunks(monkeypatch):
    parts = [T.payload(t * n)[0] for t, n in (("abc", 10), ("hello ", 700), ("", 1), ("zé", 4000))]
    want = [T.decode_adpcm(p, T.BLOCK).tolist() for p in parts]
    wide = [T.resample(np.array(w, np.int16), 8000, 11025).tolist() for w in want]
    monkeypatch.setattr(T, "CHUNK", 1000)
    assert [x.tolist() for x in T.as_adpcm(parts)] == want
    assert [T.resample(np.array(w, np.int16), 8000, 11025).tolist() for w in want] == wide


@pytest.mark.parametrize("code", [T.MU_LAW, T.A_LAW])
def test_media_round_trip_and_resampling(code):
    data, n = T.payload("hello " * 300)
    media = T.wave(data, code)
    assert T.parse(media)["samples"] == data and len(data) % T.UNIT == 0 and n == 1800
    linear, rate = T.decode(T.resampled_wave(media, 16000))
    assert rate == 16000 and len(linear) == 2 * len(data) and (linear[::2] == T.TABLES[code][np.frombuffer(data, np.uint8)]).all()


def test_features_in_pieces(monkeypatch):
    media = T.wave(T.payload("Ab\x00é" * 500)[0])
    whole = T.features(media)
    monkeypatch.setattr(T, "CHUNK", 7)
    assert T.features(media) == whole
    x = T.decode(media)[0].astype(int)
    assert whole == f"{round(float((x * x).mean()) ** 0.5)}:{abs(x).max()}:{int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())}"


def test_stored_documents(spark):
    df = fixtures.documents(spark)
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    got = T.inspect(T.store(df)).collect()
    assert len(got) == df.count()
    seen = {}
    for r in got:
        data = texts[r.doc_id]
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-32:]) and r.media_bytes > len(full)
        pcm = T.resampled_wave(T.wave(full, T.IMA_ADPCM, block=T.BLOCK))
        assert (r.pcm_bytes, r.pcm_sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())
        assert r.adpcm == T.features(T.wave(full, T.IMA_ADPCM, block=T.BLOCK)) and r.a_law == T.features(T.wave(full, T.A_LAW))
        assert seen.setdefault(data, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert T.inspect(T.store(fixtures.empty(spark))).count() == 0
    assert T.expand(T.store(df)).count() == df.count()


def test_null_media(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 576, bytearray(T.wave(b"a" * 576)))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in T.inspect(df).collect()}
    assert got[1].payload_sha256 is None and got[1].pcm_bytes is None and got[2].payload_bytes == 576
