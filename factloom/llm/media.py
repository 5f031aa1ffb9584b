"""Media columns: texts kept as 8-bit WAV, short-time spectra, and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reachable
from .words import pieces

UNIT = 576  #: a payload is a positive multiple of so many bytes
RATE = 8000  #: samples a second written to the header
FRAME, HOP = 512, 288  #: samples a spectrum takes, and from one to the next
BANDS = ((2, 24), (24, 80), (80, 257))  #: spectrum bins of the bands, each with one peak at most a frame
FAN, REACH = 2, 31  #: later peaks an anchor is paired with, and frames they may be away
TAIL = b"\x80" * (FRAME - HOP)  #: silence after the samples, so that the last frame covers the last of them
BLOCK = 4096  #: frames transformed at once, so memory does not grow with a text
SLICE = 8 << 20  #: bytes of texts, or of their media, handled at once (or one longer text)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // UNIT)) * UNIT
    return data + b"\xff" * (n - len(data))


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Peaks as (frame, bin), by frame and bin: a band's largest bin where it tops both neighbour frames."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    best, level = [], []
    for lo in range(0, len(frames), BLOCK):
        x = (frames[lo : lo + BLOCK].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(x, axis=1))
        tops = [power[:, a:b].argmax(axis=1) + a for a, b in BANDS]
        best.append(np.stack(tops, 1))
        level.append(np.stack([np.take_along_axis(power, t[:, None], 1)[:, 0] for t in tops], 1))
    best, level = np.concatenate(best), np.concatenate(level)
    edge = np.full((1, len(BANDS)), -1.0)
    peak = (level > np.concatenate([edge, level[:-1]])) & (level >= np.concatenate([level[1:], edge]))
    t, band = np.nonzero(peak)
    return t, best[t, band]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) of anchors, and hashes of (anchor bin, partner bin, frames between)."""
    t, f = band_peaks(samples)
    times, codes = [], []
    for step in range(1, FAN + 1):
        if len(t) > step:
            gap = t[step:] - t[:-step]
            near = gap <= REACH
            times.append(t[:-step][near])
            codes.append(((f[:-step] << 14) | (f[step:] << 5) | gap)[near])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def store_wav(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text as a mono 8-bit WAV file in a binary column.

    A null text counts as empty; an empty one gives 576 bytes of 255. Rows keep their number:
    repeated rows and null keys pass through, an empty table gives none. Only key and text are
    read, so other columns, whatever their names, do not matter. Memory holds SLICE bytes of
    texts, or one longer text.
    """
    reachable(docs.sparkSession)
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for b in pieces(batches, SLICE):
            raw = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            media = [to_wav(padded(x)) for x in raw]
            yield pa.record_batch([b.column("key"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def analyse(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds to (key, n_bytes, media) what reading the stored bytes back gives.

    payload_bytes, payload_sha256 and tail_crc32 are of the samples read; fp_time and fp_hash
    are the fingerprint, anchors in time order (both empty where no peak has a partner).
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        lists = pa.list_(pa.int32())
        for b in pieces(batches, SLICE, "media"):
            rows: dict[str, list] = {k: [] for k in ("n", "sha", "crc", "t", "h")}
            for m in b.column("media").to_pylist():
                payload = from_wav(m)
                t, h = fingerprint(np.frombuffer(payload + TAIL, np.uint8))
                for k, v in (("n", len(payload)), ("sha", hashlib.sha256(payload).hexdigest()), ("crc", zlib.crc32(payload[-32:])), ("t", t), ("h", h)):
                    rows[k].append(v)
            yield pa.record_batch(
                [b.column("key"), b.column("n_bytes"), b.column("media"), pa.array(rows["n"], pa.int64()), pa.array(rows["sha"]), pa.array(rows["crc"], pa.int64()), pa.array(rows["t"], lists), pa.array(rows["h"], lists)],
                ["key", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "fp_time", "fp_hash"],
            )

    src = media.select(F.col(key).alias("key"), "n_bytes", "media")
    schema = f"key {kind}, n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, fp_time array<int>, fp_hash array<int>"
    return src.mapInArrow(run, schema).withColumnRenamed("key", key)


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the stored and reread media of every document."""
    seen = analyse(store_wav(docs))
    return seen.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.lit("peaks1"), F.size("fp_hash"), F.hex(F.xxhash64("fp_time", "fp_hash"))).alias("feature"),
    )
