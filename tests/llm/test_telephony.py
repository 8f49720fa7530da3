import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from gristmill.llm import telephony as tel


def test_g711_tables():
    """Values of the recommendation, and how far codes are apart."""
    mulaw, alaw = tel.EXPAND[tel.MULAW].astype(int), tel.EXPAND[tel.ALAW].astype(int)
    assert [mulaw[c] for c in (0x00, 0x7F, 0x80, 0xFF, 0xFE, 0x8F)] == [-32124, 0, 32124, 0, 8, 16764]
    assert [alaw[c] for c in (0xD5, 0x55, 0xAA, 0x2A, 0xD4, 0x80)] == [8, -8, 32256, -32256, 24, 5504]
    assert sorted(mulaw[:128]) == sorted(-mulaw[128:]) and len(set(alaw)) == 256 and len(set(mulaw)) == 255
    assert set(np.diff(np.sort(alaw[alaw > 0]))) == {16 << i for i in range(7)} | {24 << i for i in range(6)}


def slow_ima(block):
    """One block, a nibble at a time."""
    sample, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = tel.STEPS[index]
            change = step >> 3
            for bit, shift in ((1, 2), (2, 1), (4, 0)):
                change += step >> shift if nibble & bit else 0
            sample = max(-32768, min(32767, sample - change if nibble & 8 else sample + change))
            index = max(0, min(88, index + tel.CHANGES[nibble & 7]))
            out.append(sample)
    return out


def encode_ima(x, size=64):
    """Blocks whose decoded samples follow x."""
    out, per = [], 1 + 2 * (size - 4)
    index = 0
    for lo in range(0, len(x) // per * per, per):
        sample, body = int(x[lo]), []
        head = struct.pack("<hBB", sample, index, 0)
        for v in x[lo + 1 : lo + per]:
            step = tel.STEPS[index]
            tries = [(abs(max(-32768, min(32767, sample + int(tel.CHANGE[index * 16 + c]))) - int(v)), c) for c in range(16)]
            c = min(tries)[1]
            assert step > 0
            sample = max(-32768, min(32767, sample + int(tel.CHANGE[index * 16 + c])))
            index = int(tel.NEXT[index * 16 + c]) // 16
            body.append(c)
        out.append(head + bytes(a | b << 4 for a, b in zip(body[::2], body[1::2], strict=True)))
    return b"".join(out)


def test_ima_blocks_equal_one_by_one():
    rng = np.random.default_rng(1)
    for size in (8, 64, 256):
        blocks = rng.integers(0, 256, (50, size), dtype=np.uint8)
        assert tel.decode_ima(blocks).tolist() == [slow_ima(b.tobytes()) for b in blocks]


def test_ima_follows_a_tone():
    t = np.arange(121 * 40)
    tone = (12_000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(int)
    (x,) = tel.samples([tel.parse(tel.wave(tel.IMA, encode_ima(tone)))])
    error = x[200:].astype(float) - tone[200:]
    assert len(x) == len(tone) and 10 * np.log10((tone[200:] ** 2.0).mean() / (error**2).mean()) > 25


def test_stereo_and_pcm():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 256, (2, 6, 64), dtype=np.uint8)
    both = np.stack([left.reshape(6, 16, 4), right.reshape(6, 16, 4)], axis=2).reshape(6, 128)
    (x,) = tel.samples([tel.parse(tel.wave(tel.IMA, both.tobytes(), channels=2, block=128))])
    assert (x == ((tel.decode_ima(left).astype(int) + tel.decode_ima(right)) // 2).ravel()).all()
    pcm = rng.integers(-32768, 32768, 30).astype("<i2")
    (y,) = tel.samples([tel.parse(tel.wave(tel.PCM, pcm.tobytes() + b"!", channels=2))])
    assert (y == (pcm[::2].astype(int) + pcm[1::2]) // 2).all()


@pytest.mark.parametrize("rate, target", [(8000, 16000), (8000, 8000), (11025, 16000), (44100, 16000), (16000, 8000)])
def test_resampling(rate, target, monkeypatch):
    n = rate // 4
    tone = lambda r, m: 10_000 * np.sin(2 * np.pi * 700 * np.arange(m) / r)
    y = tel.resample(np.rint(tone(rate, n)).astype(np.int16), rate, target)
    assert len(y) == -(-n * target // rate)
    inner = slice(len(y) // 10, -len(y) // 10)
    assert np.abs(y - tone(target, len(y)))[inner].max() < 60
    assert (tel.resample(np.full(500, 1234, np.int16), rate, target)[60:-60] == 1234).all()
    monkeypatch.setattr(tel, "OUTPUTS", 37)
    assert (tel.resample(np.rint(tone(rate, n)).astype(np.int16), rate, target) == y).all()
    if target > rate == 8000:  # the input's samples stay
        assert (y[::2] == np.rint(tone(rate, n)).astype(np.int16)).all()


def test_round_trip_and_digest(spark, odd_docs, no_docs):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abc é漢\n\0") for _ in range(rng.choice([0, 1, 63, 64, 65, 500])))) for i in range(60)] + [(100, None), (101, ""), (101, "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in tel.digest(docs).collect()}
    formats = set()
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        codec = list(tel.CODECS)[zlib.crc32(payload) % 3]
        formats.add(codec)
        media = tel.wave(tel.CODECS[codec], payload)
        (x,) = tel.samples([tel.parse(media)])
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == tel.feature(codec, tel.resample(x, 8000, 16000))
    assert formats == set(tel.CODECS)
    again = {r.doc_id: r for r in tel.digest(docs.repartition(7)).collect()}
    assert again == got
    assert tel.digest(no_docs).count() == 0 and tel.digest(odd_docs).count() == odd_docs.count()


def test_decode_stores_pcm_and_tells_errors(spark):
    good = tel.wave(tel.MULAW, bytes(range(256)))
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFF0000WAVEfmt \x02\0\0\0ab"), (5, good[:60]), (6, tel.wave(tel.IMA, b"")), (7, good[:20] + b"\x09" + good[21:]), (8, b"RIFF0000WAVE")]
    out = tel.decode(spark.createDataFrame([(*r, "clash") for r in rows], "id int, media binary, PCM string"))
    assert out.columns == ["id", "media", "PCM", "codec", "rate", "samples", "payload", "pcm_", "feature", "error"]
    got = {r.id: r for r in out.collect()}
    tag, channels, rate, _, bits, data = tel.parse(bytes(got[1].pcm_))
    assert (tag, channels, rate, bits) == (1, 1, 16000, 16) and bytes(got[1].payload) == bytes(range(256))
    assert (np.frombuffer(data, "<i2")[::2] == tel.EXPAND[tel.MULAW]).all() and got[1].samples == 512
    assert got[2].error is None and got[2].pcm_ is None
    assert all(got[i].error and got[i].pcm_ is None for i in (3, 4, 7, 8))
    assert got[5].error is None and bytes(got[5].payload) == bytes(range(60 - 46)) and got[6].samples == 0
    for codec in tel.CODECS:
        stored = tel.store(spark.createDataFrame([(1, "hallo")], "id int, text string"), codec=codec)
        assert tel.decode(stored).first().codec == codec
