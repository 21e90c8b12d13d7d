"""Media columns: bytes as 8-bit audio, and log-mel features of that audio as fixed-shape Arrow tensors.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, become the samples of a mono 8-bit WAV file,
losslessly. The features come from the stored file read back: polyphase resampling by 3/4, overlapped Hann frames,
mel filterbank energies in decibels, and the spans in which energy stays up, found with hysteresis.

Everything is computed text by text in blocks of fixed size, so equal texts give equal values and a long text needs no
more memory than its file and its features. Rows are independent; nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

PAD, FILL = 192, b" "
RATE, UP, DOWN = 8000, 3, 4
TAPS = 8  # of each phase
FRAME, HOP, MELS = 192, 96, 20
#: Frames of a tensor: its shape is (WINDOW, MELS).
WINDOW = 32
#: Decibels above the text's mean energy at which a span starts, and below which it ends.
HIGH, LOW = 1.5, -0.5
FLOOR = 1e-6
HEADER = 44
BLOCK = PAD * 2048
#: Bytes of results that a task gathers before it hands them on.
GATHER = 4 << 20


def payload(text: bytes) -> bytes:
    size = max(PAD, -(-len(text) // PAD) * PAD)
    return text.ljust(size, FILL)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    form = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return form + samples


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a file that to_wav() made."""
    riff, _, wave, _, _, kind, channels, rate, _, _, bits, data, size = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or len(media) != HEADER + size:
        raise ValueError("not a file of this kind")
    return media[HEADER:], rate


@lru_cache(maxsize=1)
def _phases() -> np.ndarray:
    """Taps of each of the UP phases: a windowed sinc that passes what both rates can hold."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    taps = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    return (taps / taps.sum() * UP).reshape(TAPS, UP).T[:, ::-1].astype(np.float32)


def resample(samples: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """UP outputs for each DOWN inputs; ``before`` and ``after`` are TAPS neighbours on either side."""
    wide = np.concatenate([before, samples, after]).astype(np.float32)
    out = np.empty((len(samples) // DOWN, UP), np.float32)
    for k, taps in enumerate(_phases()):
        first = TAPS + k * DOWN // UP - TAPS // 2 + 1
        views = np.lib.stride_tricks.as_strided(wide[first:], (len(out), TAPS), (DOWN * wide.itemsize, wide.itemsize), writeable=False)
        out[:, k] = views @ taps
    return out.ravel()


@lru_cache(maxsize=1)
def _filters() -> tuple[np.ndarray, np.ndarray]:
    """Hann window and triangular mel filters (bins x MELS)."""
    rate = RATE * UP // DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rising, falling = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    bank = np.maximum(0, np.minimum(rising, falling))
    bank[np.abs(bins - edges[1:-1]).argmin(axis=0), np.arange(MELS)] += 1e-3  # no filter is empty
    return np.hanning(FRAME).astype(np.float32), bank.astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Decibels (frames x MELS) and energy of each frame."""
    window, bank = _filters()
    raw = np.frombuffer(samples, np.uint8)
    rest, bands, power = np.zeros(0, np.float32), [], []
    for start in range(0, len(raw), BLOCK):
        stop = min(start + BLOCK, len(raw))
        block = (raw[max(0, start - TAPS) : stop + TAPS].astype(np.float32) - 128) / 128
        left, right = min(TAPS, start), min(TAPS, len(raw) - stop)
        before = np.concatenate([np.zeros(TAPS - left, np.float32), block[:left]])
        after = np.concatenate([block[len(block) - right :], np.zeros(TAPS - right, np.float32)]) if right else np.zeros(TAPS, np.float32)
        rest = np.concatenate([rest, resample(block[left : len(block) - right], before, after)])
        if stop == len(raw):  # the last frame is filled up with silence
            short = max(FRAME - len(rest), -(len(rest) - FRAME) % HOP)
            rest = np.concatenate([rest, np.zeros(short, np.float32)])
        count = (len(rest) - FRAME) // HOP + 1
        if count > 0:
            frames = np.lib.stride_tricks.as_strided(rest, (count, FRAME), (HOP * rest.itemsize, rest.itemsize), writeable=False) * window
            spectrum = np.fft.rfft(frames, axis=1)
            energy = spectrum.real**2 + spectrum.imag**2
            bands.append(10 * np.log10(energy.astype(np.float32) @ bank + FLOOR))
            power.append(10 * np.log10(energy.mean(axis=1) + FLOOR))
            rest = rest[count * HOP :].copy()
    return np.concatenate(bands), np.concatenate(power)


def spans(power: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """First frame and frame after the last of each stretch: it starts at mean + ``high`` and lasts until below mean + ``low``."""
    level = power - power.mean()
    event = np.where(level >= high, 1, np.where(level < low, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.concatenate([[0], (last >= 0) & (event[last] == 1), [0]]).astype(np.int8)
    change = np.diff(on)
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True))


def milliseconds(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def to_tensors(bands: np.ndarray) -> bytes:
    """An Arrow stream of (WINDOW, MELS) half-precision tensors with the time span of each; the last is filled with silence."""
    count = -(-len(bands) // WINDOW)
    whole = np.full((count * WINDOW, MELS), 10 * np.log10(FLOOR), np.float16)
    whole[: len(bands)] = bands
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(whole.reshape(count, WINDOW, MELS)))
    starts = [milliseconds(i * WINDOW) for i in range(count)]
    ends = [milliseconds(min((i + 1) * WINDOW, len(bands))) for i in range(count)]
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["log_mel", "start_ms", "end_ms"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stream: bytes) -> pa.Table:
    """The table that to_tensors() wrote: log_mel (fixed-shape tensors), start_ms, end_ms."""
    return pa.ipc.open_stream(stream).read_all()


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("segments", pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))), ("tensors", pa.binary())]
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in slices(batches, 64):
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            media = to_wav(payload(text))
            samples, _ = from_wav(media)
            bands, power = log_mel(samples)
            segments = [{"start_ms": milliseconds(a), "end_ms": milliseconds(b)} for a, b in spans(power)]
            rows.append({"doc_id": doc_id, "n_bytes": len(text), "media": media, "segments": segments, "tensors": to_tensors(bands)})
            size += len(media) + len(rows[-1]["tensors"])
            if size > GATHER:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def audio_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV file), segments (spans of raised energy) and tensors (Arrow stream) of every row.

    Null and empty texts are 192 spaces. Repeated rows give repeated results. Columns other than doc_id and text are not
    read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_features, "doc_id long, n_bytes long, media binary, segments array<struct<start_ms:long,end_ms:long>>, tensors binary")


def samples_of(media: Column) -> Column:
    """The payload of a stored file, as an expression."""
    return F.substring(media, F.lit(HEADER + 1), F.octet_length(media) - HEADER)
