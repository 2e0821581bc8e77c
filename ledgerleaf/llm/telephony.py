"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, expanded to PCM, resampled and stored.

The 8-bit codes of G.711 expand by tables of 256 entries. ADPCM is sequential within a block only, so
numpy decodes sample by sample across all blocks of a batch at once. The PCM is resampled to twice its rate by a
windowed-sinc low-pass and stored as a column of 16-bit samples, from which the features are computed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import by_slices

RATE, RESAMPLED_RATE = 8000, 16000
#: Bytes of an ADPCM block, header included; payloads are padded to whole blocks for every codec.
BLOCK = 192
PAD = b"\x20"
#: Taps of the resampler on either side of a new sample, bits of their fractions, samples resampled at once.
TAPS, FRACTION, STEP_SAMPLES = 8, 14, 1 << 20
#: Bytes of text that a task expands at once: a byte becomes up to eight.
TEXT_BYTES = 1 << 20
#: WAV format tags.
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
_TAGS = {v: k for k, v in CODECS.items()}

# Fixed values of the IMA ADPCM format: step sizes, and the change of the step index by code.
ADPCM_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
ADPCM_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power, low = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    value = np.where(power == 0, low, low + 0x100 << np.maximum(power - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 1 + 2 * (BLOCK - 4)) samples of (n, BLOCK) bytes: a header (first sample, step index, a spare byte), then two codes a byte, the low one first."""
    n = len(blocks)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(ADPCM_STEPS) - 1).astype(np.int32)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(n, -1).T.astype(np.int32)
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = head
    for k, code in enumerate(codes, 1):
        step = ADPCM_STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        head = np.clip(head + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + ADPCM_INDEX[code], 0, len(ADPCM_STEPS) - 1)
        out[k] = head
    return out.T


@lru_cache(maxsize=1)
def taps() -> np.ndarray:
    """The low-pass at half the new rate: a sinc under a Hann window at distances 1/2, 3/2, ..., adding up to one half."""
    at = np.arange(TAPS) + 0.5
    ideal = np.sinc(at) * np.cos(np.pi * at / (2 * TAPS + 1)) ** 2
    scaled = np.round(ideal / ideal.sum() * (1 << FRACTION - 1)).astype(np.int32)
    scaled[0] += (1 << FRACTION - 1) - scaled.sum()
    return scaled


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between each two the low-pass of TAPS on either side, in whole numbers; edge samples are held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    for at in range(0, len(pcm), STEP_SAMPLES):
        n = min(STEP_SAMPLES, len(pcm) - at)
        near = np.clip(np.arange(at - TAPS + 1, at + n + TAPS), 0, len(pcm) - 1)
        x = pcm[near].astype(np.int32)
        total = np.full(n, 1 << FRACTION - 1, np.int32)
        for k, c in enumerate(taps()):
            total += c * (x[TAPS - 1 - k : TAPS - 1 - k + n] + x[TAPS + k : TAPS + k + n])
        out[2 * at + 1 : 2 * (at + n) : 2] = np.clip(total >> FRACTION, -32768, 32767)
    return out


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * ((-len(raw)) % BLOCK if raw else BLOCK)


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file of one channel whose data chunk is ``payload``."""
    adpcm = codec == "adpcm"
    align = BLOCK if adpcm else 1
    samples = 2 * (BLOCK - 4) + 1
    per_second = RATE * BLOCK // samples if adpcm else RATE
    extra = struct.pack("<HH", 2, samples) if adpcm else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", CODECS[codec], 1, RATE, per_second, align, 4 if adpcm else 8) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and data of a WAV file, found by walking over its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = _TAGS[struct.unpack_from("<H", media, at + 8)[0]]
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(files: list[bytes]) -> list[tuple[str, np.ndarray]]:
    """Codec and PCM at RESAMPLED_RATE of each file; ADPCM blocks of all files are decoded together."""
    read = [read_wav(f) for f in files]
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, BLOCK) for c, d in read if c == "adpcm"]
    decoded = iter(np.split(decode_adpcm(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1]) if blocks else [])
    out = []
    for c, d in read:
        pcm = next(decoded).ravel() if c == "adpcm" else (mulaw_table() if c == "mulaw" else alaw_table())[np.frombuffer(d, np.uint8)]
        out.append((c, resample_double(pcm)))
    return out


def store(docs: DataFrame, codec: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as the codes of a WAV file.

    The codec is ``codec``, or follows from the payload's CRC-32, so that equal texts are stored alike. A
    null text counts as empty; its payload is one block of padding. Repeated rows are stored repeatedly; an empty table
    gives an empty result. ``doc_id`` is a whole number; other columns are not read.
    """

    def fn(x: dict) -> dict:
        payloads = [payload_of(t) for t in x["text"]]
        names = list(CODECS)
        return {
            "doc_id": x["doc_id"],
            "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in x["text"]],
            "media": [wav(p, codec or names[zlib.crc32(p) % 3]) for p in payloads],
        }

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(by_slices(fn, schema), "doc_id bigint, n_bytes bigint, media binary")


def with_pcm(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` with ``codec, rate, pcm``: 16-bit little-endian samples at RESAMPLED_RATE. A null file has no samples."""

    def fn(x: dict) -> dict:
        made = iter(expand([m for m in x["media"] if m is not None]))
        each = [(None, None) if m is None else next(made) for m in x["media"]]
        return x | {"codec": [c for c, _ in each], "rate": [RESAMPLED_RATE] * len(each), "pcm": [None if p is None else p.astype("<i2").tobytes() for _, p in each]}

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("rate", pa.int32()), ("pcm", pa.binary())])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(by_slices(fn, schema, 64, TEXT_BYTES), "doc_id bigint, n_bytes bigint, media binary, codec string, rate int, pcm binary")


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean square and sign changes of the resampled samples."""
    wide = pcm.astype(np.int64)
    signs = pcm >= 0
    return f"{codec} n={len(pcm)} peak={int(np.abs(wide).max())} power={int((wide * wide).sum()) // len(wide)} crossings={int(np.count_nonzero(signs[1:] != signs[:-1]))}"


def media_report(stored: DataFrame) -> DataFrame:
    """Per stored file: digests of the data read back, of the file and of the stored samples, and the feature of the samples."""

    def fn(x: dict) -> dict:
        data = [read_wav(m)[1] for m in x["media"]]
        return {
            "doc_id": x["doc_id"], "n_bytes": x["n_bytes"],
            "payload_bytes": [len(d) for d in data],
            "payload_sha256": [hashlib.sha256(d).hexdigest() for d in data],
            "tail_crc32": [zlib.crc32(d[-16:]) for d in data],
            "media_bytes": [len(m) for m in x["media"]],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in x["media"]],
            "pcm_bytes": [len(p) for p in x["pcm"]],
            "pcm_sha256": [hashlib.sha256(p).hexdigest() for p in x["pcm"]],
            "feature": [feature(c, np.frombuffer(p, "<i2")) for c, p in zip(x["codec"], x["pcm"], strict=True)],
        }

    fields = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "pcm_bytes": "bigint", "pcm_sha256": "string", "feature": "string"}
    schema = pa.schema([(k, pa.int64() if t == "bigint" else pa.string()) for k, t in fields.items()])
    rows = stored.select("doc_id", "n_bytes", "media", "codec", "pcm").where("media is not null")
    return rows.mapInArrow(by_slices(fn, schema, 64, 8 * TEXT_BYTES), ", ".join(f"{k} {t}" for k, t in fields.items()))
