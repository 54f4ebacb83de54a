import hashlib
import zlib

import numpy as np

from sightline.llm import audio


def ima_scalar(data, value, at):
    out = []
    for byte in data:
        for n in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[at])
            change = step >> 3
            for bit, shift in ((1, 2), (2, 1), (4, 0)):
                change += (step >> shift) if n & bit else 0
            value = max(-32768, min(32767, value - change if n & 8 else value + change))
            at = max(0, min(88, at + int(audio.IMA_MOVES[n])))
            out.append(value)
    return out


def test_tables_of_known_values():
    mu, a = audio.TABLES[audio.MU_LAW], audio.TABLES[audio.A_LAW]
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_adpcm_across_blocks_equals_block_by_block():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (50, 36), np.uint8)
    data[:, 2] %= 89
    raw = data.tobytes()
    got = audio.expand([(audio.IMA_ADPCM, 8000, 36, raw), (audio.IMA_ADPCM, 8000, 36, raw[:36] + b"rest"), (audio.IMA_ADPCM, 8000, 36, b"")])
    want = [v for b in data for f in [int(b[:2].view("<i2")[0])] for v in [f, *ima_scalar(b[4:].tolist(), f, int(b[2]))]]
    assert got[0].tolist() == want and got[1].tolist() == want[:65] and len(got[2]) == 0


def test_files_round_trip_and_resample(spark):
    payload = bytes(range(256))
    files = [audio.wav(payload, audio.MU_LAW), audio.wav(payload, audio.A_LAW), audio.wav(payload, audio.PCM, bits=16, align=2), audio.wav(payload[:72], audio.IMA_ADPCM, bits=4, align=36, extra=b"\x41\0"), audio.wav(b"", audio.MU_LAW), None, b"junk", audio.wav(payload, audio.MU_LAW)[:80]]
    assert all(audio.read_wav(f)[3] == payload[: len(audio.read_wav(f)[3])] for f in files[:5])
    got = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    rows = {r.id: r for r in audio.decode_media(got).collect()}
    assert [rows[i].n_samples for i in range(8)] == [512, 512, 256, 260, 0, None, None, None]
    assert rows[6].error and rows[7].error and rows[5].error is None
    samples = np.frombuffer(audio.read_wav(rows[0].pcm)[3], "<i2")
    assert (samples[::2] == audio.TABLES[audio.MU_LAW]).all()
    flat = audio.resample(np.full(50, 1000, np.int16), 8000, 16000)
    assert (abs(flat - 1000) <= 1).all() and len(audio.resample(np.arange(10, dtype=np.int16), 8000, 12000)) == 15


def test_payload_query_is_lossless(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "x" * 64, "c"), (4, "é" * 40, "c"), (5, "long " * 30000, "c"), (6, "é" * 40, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r.doc_id: r for r in audio.payload_features(audio.payload_media(docs)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        ima = [v for k in range(0, len(payload), 64) for v in ima_scalar(payload[k : k + 64], 0, 0)] if len(payload) < 999 else None
        assert ima is None or r.feature.endswith(f"/{max(map(abs, ima))}/{sum((x < 0) != (y < 0) for x, y in zip(ima, ima[1:]))}")
    assert got[4].feature == got[6].feature and got[4].media_sha256 == got[6].media_sha256
    assert audio.payload_features(audio.payload_media(docs.limit(0))).count() == 0
