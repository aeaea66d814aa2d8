"""Audio columns: WAV files in a binary column, short-time Fourier transforms and fingerprints of pairs of spectral peaks.

`encode` writes bytes as a mono WAV file of 8-bit samples, one sample a byte, padded to whole frames with 255; `analyse` reads such a file back
(with the wave module) and computes its fingerprint: the strongest bin of every frequency band in every window is a peak if it is not weaker than
the band's peaks just before and after; every peak is paired with the next few ones; a pair is one number made of its time, both frequencies and the time between.
The numbers form an array, sorted by time. A match of two recordings is many equal pairs at one time difference.

Defined results: null counts as empty, and an empty payload is one frame of padding. Equal bytes give equal files and features: each file is transformed on
its own, in blocks of windows, so memory grows with the number of peaks of a file only. A binary column that is no such WAV file is refused by the wave module."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.frames import table

FRAME = 576
PAD = b"\xff"
RATE = 8000
HOP = FRAME // 2
#: Bins where the frequency bands begin and end.
BANDS = (2, 12, 24, 48, 96, 160, 289)
#: Following peaks that one is paired with, and windows they may be later.
FANOUT, REACH = 3, 63
BLOCK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(raw: bytes) -> bytes:
    """The bytes, padded to a positive multiple of FRAME."""
    return raw + PAD * (-len(raw) % FRAME if raw else FRAME)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise wave.Error("mono 8-bit samples are wanted")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window number and bin of each spectral peak, by time."""
    windows = max((len(samples) - FRAME) // HOP + 1, 0)
    bins, values = np.zeros((windows, len(BANDS) - 1), np.int32), np.zeros((windows, len(BANDS) - 1), np.float32)
    for a in range(0, windows, BLOCK):
        b = min(a + BLOCK, windows)
        part = np.lib.stride_tricks.sliding_window_view(samples[a * HOP : (b - 1) * HOP + FRAME], FRAME)[::HOP]
        size = np.abs(np.fft.rfft((part.astype(np.float32) - 128) * _WINDOW, axis=1))
        for i, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            at = size[:, low:high].argmax(axis=1)
            bins[a:b, i] = at + low
            values[a:b, i] = size[np.arange(b - a), at + low]
    strong = values > 0
    strong[1:] &= values[1:] >= values[:-1]
    strong[:-1] &= values[:-1] >= values[1:]
    time, band = np.nonzero(strong)
    return time, bins[time, band]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, int]:
    """The pairs of peaks as numbers: time, first bin (10 bits), second bin (10 bits), distance (6 bits); and the number of peaks."""
    time, at = peaks(samples)
    found = []
    for ahead in range(1, FANOUT + 1):
        t, d = time[:-ahead], time[ahead:] - time[:-ahead]
        ok = d <= REACH
        found.append((t[ok] << 26) | (at[:-ahead][ok].astype(np.int64) << 16) | (at[ahead:][ok].astype(np.int64) << 6) | d[ok])
    return np.sort(np.concatenate(found)), len(time)


def encode(raw: Column) -> Column:
    """A WAV file with the bytes of a text or binary column."""

    def of(values: pa.Array) -> pa.Array:
        return pa.array((to_wav(payload(v.as_py() or b"")) for v in values), pa.binary())

    return F.arrow_udf(of, "binary")(raw.cast("binary"))


RESULT = "struct<payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>>"


def analyse(media: Column) -> Column:
    """A struct of what a WAV file holds: its samples' number, digest and the check sum of the last 32, the file's size and digest, the fingerprint
    and its digest (windows:peaks:pairs:sha256)."""

    def of(values: pa.Array) -> pa.Array:
        rows, prints = [], []
        for v in values:
            file = v.as_py()
            back = from_wav(file)
            pairs, n = fingerprint(np.frombuffer(back, np.uint8))
            windows = max((len(back) - FRAME) // HOP + 1, 0)
            digest = hashlib.sha256(pairs.astype("<i8").tobytes()).hexdigest()
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"{windows}:{n}:{len(pairs)}:{digest}"))
            prints.append(pairs)
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(prints, pa.list_(pa.int64()))],
                                          names=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"])

    return F.arrow_udf(of, RESULT)(media)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), analyse(encode(F.col("text"))).alias("r"))
    return rows.select("doc_id", "n_bytes", *[f"r.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])


QUERIES = {"op5_wav_fingerprints": (query, None)}
