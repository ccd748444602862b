"""Audio columns: lossless 8-bit WAV, polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segments.

Samples are resampled by a windowed-sinc filter of which each output uses the one phase it needs, cut in overlapping Hann
frames, and turned into log energies of mel bands. Frames of a clip are stored as tensors of a fixed shape (CHUNK frames by MELS
bands, the last one padded with the floor) with the span of time each covers: an Arrow stream in a binary column, its tensors of
Arrow's fixed-shape type. Segments begin where the frame energy rises over
an upper threshold and end where it falls below a lower one, both over the clip's own noise floor. Clips are worked on in
runs of frames, so memory does not grow with a clip's length.

Null and empty bytes: one block of zeros by the padding rule, hence one frame. Equal bytes give equal columns. Empty table: no
rows. Repeated rows: each for itself. Other columns: kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, TO_RATE = 16000, 8000
FRAME, HOP, MELS, CHUNK = 256, 128, 32, 96
TAPS = 16
FLOOR = -10.0
#: Decibels over the noise floor at which a segment begins and below which it ends.
UPPER, LOWER = 6.0, 3.0
BLOCK = 64
#: Frames worked on at once.
RUN = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media)) as f:
        return f.readframes(f.getnframes()), f.getframerate()


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """data with bytes 0 up to a positive multiple of block."""
    return data + b"\0" * (max(block, -(-len(data) // block) * block) - len(data))


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """x at another rate; only the filter phase that an output needs is computed."""
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    if up == down:
        return x
    wide = max(up, down)
    half = TAPS * wide // up  # input samples to each side
    n = -(-len(x) * up // down)
    y = np.empty(n)
    xp = np.concatenate([np.zeros(half), x, np.zeros(half + down)])
    for phase in range(min(up, n)):
        m = np.arange(phase, n, up)
        frac = (phase * down % up) / up
        t = np.arange(-half + 1, half + 1) - frac
        h = np.sinc(t * up / wide) * np.cos(np.clip(np.pi * t / (2 * half), -np.pi / 2, np.pi / 2)) ** 2 * up / wide
        first = phase * down // up + 1
        y[m] = sliding_window_view(xp, 2 * half)[first : first + (len(m) - 1) * down + 1 : down] @ h
    return y


def mel_bank(rate: int = TO_RATE, frame: int = FRAME, bands: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))


_WINDOW = np.hanning(FRAME + 1)[:-1]
_BANK = mel_bank()


def log_mel(payload: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x bands) and each frame's energy in decibels."""
    raw = np.frombuffer(payload, np.uint8)
    g = int(np.gcd(rate, TO_RATE))
    up, down = TO_RATE // g, rate // g
    total = -(-len(raw) * up // down)
    frames = max(1, -(-(total - FRAME) // HOP) + 1)
    mels, energy = [], []
    halo = -(-(TAPS * max(up, down) // up + 2 * down) // down) * down * 2  # input samples beside a run, whole filter periods
    for a in range(0, frames, RUN):
        b = min(frames, a + RUN)
        lo, hi = a * HOP, min(total, (b - 1) * HOP + FRAME)
        from_in = max(0, lo // up * down - halo)
        x = (raw[from_in : hi // up * down + halo + down].astype(np.float64) - 128) / 128
        y = resample(x, rate, TO_RATE)[lo - from_in // down * up : hi - from_in // down * up]
        y = np.concatenate([y, np.zeros(max(0, (b - a - 1) * HOP + FRAME - len(y)))])
        cut = sliding_window_view(y, FRAME)[::HOP][: b - a] * _WINDOW
        power = np.abs(np.fft.rfft(cut, axis=1)) ** 2 / FRAME
        mels.append(np.log10(np.maximum(power @ _BANK, 10**FLOOR)))
        energy.append(10 * np.log10(np.maximum((cut * cut).mean(axis=1), 1e-10)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> np.ndarray:
    """First and end frame of each segment, by two thresholds over the noise floor (the tenth percentile)."""
    floor = np.percentile(energy, 10)
    mark = np.where(energy >= floor + UPPER, 1, np.where(energy < floor + LOWER, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    step = np.diff(np.r_[0, on, 0])
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)


def tensors(mels: np.ndarray) -> np.ndarray:
    """Tensors of CHUNK x MELS; what the last one lacks is the floor."""
    n = -(-len(mels) // CHUNK)
    out = np.full((n * CHUNK, MELS), FLOOR, np.float32)
    out[: len(mels)] = mels
    return out.reshape(n, CHUNK, MELS)


def stored_tensors(mels: np.ndarray) -> bytes:
    """The tensors of a clip with the time each covers, as an Arrow stream."""
    held, second = tensors(mels), HOP / TO_RATE
    first = np.arange(len(held)) * CHUNK
    last = np.minimum(first + CHUNK, len(mels)) - 1
    flat = pa.FixedSizeListArray.from_arrays(pa.array(held.ravel()), CHUNK * MELS)
    columns = [pa.array(first * second), pa.array(last * second + FRAME / TO_RATE), pa.ExtensionArray.from_storage(_TENSORS.field("tensor").type, flat)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TENSORS) as f:
        f.write_batch(pa.RecordBatch.from_arrays(columns, schema=_TENSORS))
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """(start_s, end_s, tensor) of a stored clip; the last column is Arrow's fixed-shape tensor type."""
    with pa.ipc.open_stream(stored) as f:
        return f.read_all()


def summary(mels: np.ndarray, energy: np.ndarray, spans: np.ndarray) -> str:
    means = ",".join(f"{v:.2f}" for v in mels.mean(axis=0))
    return f"frames={len(mels)};db={energy.mean():.2f};segments={len(spans)};voiced={int((spans[:, 1] - spans[:, 0]).sum())};mel={means}"


_SCHEMAS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media": "binary", "media_bytes": "long", "media_sha256": "string", "feature": "string",
    "tensors": "binary", "segments": "array<struct<start_s: double, end_s: double>>",
}
_TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", pa.fixed_shape_tensor(pa.float32(), [CHUNK, MELS], dim_names=["frame", "band"]))])
_SEGMENTS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
COLUMNS = tuple(_SCHEMAS)


def audio(df: DataFrame, column: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """df, without `column` (string or binary), with the given audio columns of its bytes: the WAV file, digests of the payload
    read back from it, log-mel tensors with their time spans, segments and a summary."""
    names = df.columns
    at = names.index(column)
    rest = [i for i in range(len(names)) if i != at]

    def one(data: bytes) -> dict:
        media = to_wav(padded(data))
        payload, rate = from_wav(media)
        out = {"n_bytes": len(data), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media": media, "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
        if {"feature", "tensors", "segments"} & {*columns}:
            mels, energy = log_mel(payload, rate)
            spans = segments(energy)
            second = HOP / TO_RATE
            out["feature"] = summary(mels, energy, spans)
            out["segments"] = [{"start_s": a * second, "end_s": ((b - 1) * HOP + FRAME) / TO_RATE} for a, b in spans.tolist()]
            if "tensors" in columns:
                out["tensors"] = stored_tensors(mels)
        return {c: out[c] for c in columns}

    @common.trimmed
    def run(batches):
        kinds = {"tensors": pa.binary(), "segments": _SEGMENTS, "media": pa.binary()}
        for batch in batches:
            found = [one(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *(pa.array([r[c] for r in found], kinds.get(c) or (pa.string() if _SCHEMAS[c] == "string" else pa.int64())) for c in columns)], [f"c{i}" for i in range(len(rest) + len(columns))])

    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join([*(f"c{k} {df.schema[i].dataType.simpleString()}" for k, i in enumerate(rest)), *(f"c{len(rest) + k} {_SCHEMAS[c]}" for k, c in enumerate(columns))])
    return common.batched(plain).mapInArrow(run, schema).toDF(*(names[i] for i in rest), *columns)
