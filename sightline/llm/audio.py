"""Telephony audio as media columns.

Mu-law and A-law samples are expanded by lookup tables of 256 values, ADPCM blocks are decoded in
numpy across all blocks of a batch (one step for each sample of a block, every block at once), and
the result is resampled and stored as 16-bit PCM. Files are RIFF/WAVE.

Defined results: null media gives null PCM; bytes that are no such file give null PCM and the
reason in ``error``; a file without samples gives a file without samples. In ``payload_media`` a
null text is empty, and equal texts give equal bytes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import map_arrow, text_of

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 0x11
RATE, OUT_RATE, UNIT = 8000, 16000, 64

# Fixed values of the IMA ADPCM format: step sizes and index moves.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, step = code >> 4 & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent == 0, step, (step + 256) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def ima_decode(data: np.ndarray, predictor: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Samples (blocks, 2 x bytes) of nibbles (blocks, bytes), low nibble first, from each block's state."""
    value, at = predictor.astype(np.int32), np.clip(index, 0, 88).astype(np.int32)
    out = np.empty((2 * data.shape[1], len(data)), np.int16)
    columns = np.ascontiguousarray(data.T)
    for k in range(len(out)):
        nibble = columns[k // 2] >> 4 if k % 2 else columns[k // 2] & 15
        step = IMA_STEPS[at]
        change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        at = np.clip(at + IMA_MOVES[nibble], 0, 88)
        out[k] = value
    return out.T


def wav(data: bytes, tag: int, *, rate: int = RATE, bits: int = 8, align: int = 1, extra: bytes = b"") -> bytes:
    """A one-channel RIFF/WAVE file."""
    per_block = struct.unpack("<H", extra[:2])[0] if tag == IMA_ADPCM else 1
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per_block, align, bits) + (b"" if tag == PCM else struct.pack("<H", len(extra)) + extra)
    fact = b"" if tag == PCM else struct.pack("<4sII", b"fact", 4, len(data) // align * per_block)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(raw: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block align, data); ValueError if it is none."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, found = 12, {}
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        if at + 8 + size > len(raw):
            raise ValueError("chunk is cut off")
        found.setdefault(name, raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if b"fmt " not in found or b"data" not in found or len(found[b"fmt "]) < 16:
        raise ValueError("no format or no data")
    tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1 or tag not in (PCM, A_LAW, MU_LAW, IMA_ADPCM) or not rate or not align:
        raise ValueError("unsupported format")
    return tag, rate, align, found[b"data"]


def expand(files: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each file; ADPCM blocks of equal size are decoded together."""
    out: list[np.ndarray | None] = [None] * len(files)
    blocks: dict[int, list[int]] = {}
    for i, (tag, _, align, data) in enumerate(files):
        if tag in TABLES:
            out[i] = TABLES[tag][np.frombuffer(data, np.uint8)]
        elif tag == PCM:
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        elif align <= 4 or len(data) < align:
            out[i] = np.empty(0, np.int16)
        else:
            blocks.setdefault(align, []).append(i)
    for align, of in blocks.items():
        sizes = [len(files[i][3]) // align for i in of]
        raw = np.frombuffer(b"".join(files[i][3][: n * align] for i, n in zip(of, sizes, strict=True)), np.uint8).reshape(-1, align)
        first = np.ascontiguousarray(raw[:, :2]).view("<i2")[:, 0]
        samples = np.column_stack([first, ima_decode(raw[:, 4:], first, raw[:, 2])])
        for i, part in zip(of, np.split(samples, np.cumsum(sizes)[:-1]), strict=True):
            out[i] = part.reshape(-1)
    return out


def half_band(taps: int = 8) -> np.ndarray:
    """Windowed-sinc weights for the point midway between samples."""
    x = np.arange(taps) - (taps - 1) / 2
    w = np.sinc(x) * (0.5 + 0.5 * np.cos(np.pi * x / (taps / 2 + 0.5)))
    return (w / w.sum()).astype(np.float32)


_HALF = half_band()


def doubled(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples themselves, and between each two a windowed-sinc mean; ends are held."""
    if not len(samples):
        return samples.astype("<i2")
    pad = len(_HALF) // 2
    held = np.concatenate([np.repeat(samples[:1], pad - 1), samples, np.repeat(samples[-1:], pad)]).astype(np.float32)
    out = np.empty(2 * len(samples), "<i2")
    out[::2] = samples
    out[1::2] = np.clip(np.rint(np.convolve(held, _HALF, "valid")), -32768, 32767)
    return out


def resample(samples: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """Samples at another rate: doubling by the half-band filter, any other ratio by linear interpolation."""
    if rate == out_rate or not len(samples):
        return samples.astype("<i2")
    if out_rate == 2 * rate:
        return doubled(samples)
    at = np.arange(len(samples) * out_rate // rate) * (rate / out_rate)
    return np.rint(np.interp(at, np.arange(len(samples)), samples)).astype("<i2")


def decode_media(media: DataFrame, *, media_col: str = "media", id_col: str = "doc_id", out_rate: int = OUT_RATE) -> DataFrame:
    """Files of telephony audio -> (id, pcm, n_samples, error): each as a 16-bit file at ``out_rate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, errors = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    files.append(None if raw is None else read_wav(raw))
                    errors.append(None)
                except ValueError as e:
                    files.append(None)
                    errors.append(str(e))
            known = [f for f in files if f]
            samples = iter([resample(s, f[1], out_rate) for s, f in zip(expand(known), known, strict=True)])
            pcm = [next(samples) if f else None for f in files]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if s is None else wav(s.tobytes(), PCM, rate=out_rate, bits=16, align=2) for s in pcm], pa.binary()), pa.array([None if s is None else len(s) for s in pcm], pa.int64()), pa.array(errors, pa.string())],
                ["id", "pcm", "n_samples", "error"],
            )

    return map_arrow(media.select(media[id_col].cast("long").alias("id"), media[media_col].cast("binary").alias("media")), run, "id long, pcm binary, n_samples long, error string")


def payload_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tag: int = MU_LAW) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes, with zeros up to a positive multiple of 64, as the 8-bit samples of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "replace") for t in text_of(batch.column(1))]
            files = [wav(r + b"\0" * (max(UNIT, -(-len(r) // UNIT) * UNIT) - len(r)), tag) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


def _figures(samples: np.ndarray) -> str:
    """Root mean square, peak and sign changes, in whole numbers."""
    wide = samples.astype(np.int64)
    square = int(wide @ wide)
    return f"{int((square // max(1, len(wide))) ** 0.5)}/{int(np.abs(wide).max(initial=0))}/{int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))}"


def payload_features(media: DataFrame) -> DataFrame:
    """Reads the stored files of ``payload_media`` back: digests of payload, file and resampled PCM, and features of the payload heard as mu-law, A-law and ADPCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2).to_pylist()
            files = [read_wav(m) for m in stored]
            payloads = [f[3] for f in files]
            mu = expand(files)
            a = expand([(A_LAW, *f[1:]) for f in files])
            blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
            still = np.zeros(len(blocks), np.int32)
            ima = ima_decode(blocks, still, still)
            ends = np.cumsum([len(p) // UNIT for p in payloads])
            pcm = [resample(s, f[1], OUT_RATE).tobytes() for s, f in zip(mu, files, strict=True)]
            columns = {
                "doc_id": batch.column(0),
                "n_bytes": batch.column(1),
                "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                "media_bytes": pa.array([len(m) for m in stored], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                "feature": pa.array([f"mu {_figures(m)} a {_figures(s)} ima {_figures(ima[e - len(p) // UNIT : e].reshape(-1))}" for m, s, p, e in zip(mu, a, payloads, ends, strict=True)]),
                "pcm_bytes": pa.array([len(p) for p in pcm], pa.int64()),
                "pcm_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pcm]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_arrow(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string", size=4 << 20)
