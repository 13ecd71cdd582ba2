"""Media columns: lossless WAV bytes, and spectral-peak pair fingerprints from them.

A payload of bytes is stored as the 8-bit samples of a mono WAV file in a binary column of a written table. Reading goes through the wave module:
a short-time Fourier transform (frames of ``FRAME`` samples, a Hann window, half a frame apart) gives power spectra; the strongest
local maxima of each frame are its peaks; each peak is paired with the strongest peaks of the frames after it. A pair's code holds both
bins and the frames between; the pairs are stored as two arrays, times and codes.

All is narrow: no row is shuffled, and a text's features need its bytes alone, in blocks of ``FRAMES`` frames. Equal bytes give equal features.

Defined results: a very long text's features are made in blocks of frames, its bytes are held a few times in its task; a null or empty text is ``FRAME`` bytes of 255 (silence, without peaks); repeated rows are returned each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save

FRAME, HOP, PAD = 576, 288, b"\xff"
SAMPLE_RATE = 8000
PEAKS, REACH, FRAMES = 3, 3, 4096
WINDOW = np.hanning(FRAME)


def padded(data: bytes) -> bytes:
    return data + PAD * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """Bins of each frame's strongest local maxima, strongest first; 0 where there is none."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.zeros((len(frames), PEAKS), np.int64)
    for at in range(0, len(frames), FRAMES):
        part = (frames[at : at + FRAMES].astype(np.float64) - 128) * WINDOW
        part -= part.mean(1, keepdims=True)
        spectrum = np.fft.rfft(part, axis=1)
        level = np.rint(8 * np.log2(1 + spectrum.real**2 + spectrum.imag**2)).astype(np.int32)
        inner = level[:, 1:-1]
        top = (inner > level[:, :-2]) & (inner >= level[:, 2:]) & (inner > 0)
        # the bin in the low digits makes every value one of its own
        value = np.where(top, inner * 1024 + np.arange(1, inner.shape[1] + 1), 0)
        best = -np.sort(-np.partition(value, -PEAKS, axis=1)[:, -PEAKS:], axis=1)
        out[at : at + FRAMES] = best % 1024
    return out


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of the pairs, by time."""
    bins = peaks(samples)
    times, codes = [], []
    for gap in range(min(REACH + 1, len(bins))):
        first, second = bins[: len(bins) - gap], bins[gap:, :1]
        if gap == 0:
            first = first[:, 1:]
        ok = (first > 0) & (second > 0)
        code = ((first << 9 | second) << 2) | gap
        times.append(np.nonzero(ok)[0])
        codes.append(code[ok])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, data), pa.int64()), pa.array((to_wav(padded(d)) for d in data), pa.binary())], ["doc_id", "n_bytes", "media"])


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            rows = []
            for media in part.column(2):
                media = media.as_py()
                payload = from_wav(media)
                t, c = fingerprint(np.frombuffer(payload, np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), t, c))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            for i in (5, 6):
                ends = np.cumsum([0, *(len(r[i]) for r in rows)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[i] for r in rows]) if rows else np.empty(0, np.int32))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], [x.split()[0] for x in SCHEMA.split(", ")])


def store(docs: DataFrame) -> DataFrame:
    """The media table: doc_id, n_bytes and the WAV file of each whole text."""
    return save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def analyse(media: DataFrame) -> DataFrame:
    """Checks, and the fingerprint arrays, from the stored bytes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_analyse, SCHEMA)
