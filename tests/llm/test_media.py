import hashlib
import math
import zlib

import numpy as np
import pytest

from lakeloom.llm import media


def brute_log_mel(payload):
    """Half the rate by the filter's sum for each sample, then a Fourier sum for each frame and band triangles one by one."""
    x = [(b - 128) / 128 for b in payload]
    wide = media.TAPS * 2
    y = []
    for m in range((len(x) + 1) // 2):
        total = 0.0
        for j in range(-wide + 1, wide + 1):
            if 0 <= 2 * m + j < len(x):
                h = 1.0 if j == 0 else math.sin(math.pi * j / 2) / (math.pi * j / 2)
                total += x[2 * m + j] * h * math.cos(min(math.pi / 2, max(-math.pi / 2, math.pi * j / (2 * wide)))) ** 2 / 2
        y.append(total)
    frames = max(1, -(-(len(y) - media.FRAME) // media.HOP) + 1)
    y += [0.0] * (frames * media.HOP + media.FRAME)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(media.TO_RATE / 2) * i / (media.MELS + 1) / 2595) - 1) for i in range(media.MELS + 2)]
    mels, energy = [], []
    for k in range(frames):
        cut = [y[k * media.HOP + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / media.FRAME)) for i in range(media.FRAME)]
        power = []
        for f in range(media.FRAME // 2 + 1):
            turn = np.exp(-2j * math.pi * f * np.arange(media.FRAME) / media.FRAME)
            power.append(abs(np.dot(cut, turn)) ** 2 / media.FRAME)
        row = []
        for lo, top, hi in zip(edges, edges[1:], edges[2:], strict=False):
            total = 0.0
            for f, e in enumerate(power):
                at = f * media.TO_RATE / media.FRAME
                total += e * max(0.0, min((at - lo) / (top - lo), (hi - at) / (hi - top)))
            row.append(math.log10(max(total, 1e-10)))
        mels.append(row)
        energy.append(10 * math.log10(max(sum(v * v for v in cut) / media.FRAME, 1e-10)))
    return np.array(mels), np.array(energy)


def brute_segments(energy):
    floor, on, out = np.percentile(energy, 10), False, []
    for i, e in enumerate(energy):
        if not on and e >= floor + media.UPPER:
            on = True
            out.append([i, len(energy)])
        elif on and e < floor + media.LOWER:
            on = False
            out[-1][1] = i
    return [tuple(x) for x in out]


def test_round_trip_columns(spark):
    texts = [None, "", "é" * 32, "a" * 64, "b" * 65, "words and words " * 5000, "dup", "dup"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = media.audio(df, "text").toArrow()
    assert got.column_names == ["doc_id", "media", *media.COLUMNS]
    got = got.rename_columns(["doc_id", "old", *media.COLUMNS])
    rows = sorted(got.to_pylist(), key=lambda r: r["doc_id"])
    for r, t in zip(rows, texts, strict=True):
        data = (t or "").encode()
        want = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert media.from_wav(r["media"]) == (want, media.RATE)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        held = media.read_tensors(r["tensors"])
        assert held.column("tensor").type.shape == [media.CHUNK, media.MELS]
        mels, energy = brute_log_mel(want) if len(want) < 1000 else media.log_mel(want)
        values = np.concatenate([x.as_py() for x in held.column("tensor").chunk(0).storage]).reshape(-1, media.MELS)
        assert np.allclose(values[: len(mels)], mels, atol=1e-4) and (values[len(mels) :] == media.FLOOR).all()
        assert held.column("start_s").to_pylist() == pytest.approx([k * media.CHUNK * media.HOP / media.TO_RATE for k in range(held.num_rows)])
        assert held.column("end_s")[-1].as_py() == pytest.approx(((len(mels) - 1) * media.HOP + media.FRAME) / media.TO_RATE)
        spans = brute_segments(energy)
        assert [(pytest.approx(x["start_s"]), pytest.approx(x["end_s"])) for x in r["segments"]] == [(a * media.HOP / media.TO_RATE, ((b - 1) * media.HOP + media.FRAME) / media.TO_RATE) for a, b in spans]
        assert r["feature"] == f"frames={len(mels)};db={energy.mean():.2f};segments={len(spans)};voiced={sum(b - a for a, b in spans)};mel=" + ",".join(f"{v:.2f}" for v in mels.mean(axis=0))
    assert {k: v for k, v in rows[6].items() if k != "doc_id"} == {k: v for k, v in rows[7].items() if k != "doc_id"}
    assert media.audio(df.limit(0), "text").count() == 0


@pytest.mark.parametrize(("rate", "to"), [(16000, 8000), (8000, 12000), (16000, 12000), (44100, 16000)])
def test_resampling_keeps_a_tone(rate, to):
    t = np.arange(rate) / rate
    y = media.resample(np.sin(2 * np.pi * 440 * t), rate, to)
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / to)
    assert len(y) == to and np.abs(y - want)[200:-200].max() < 0.01


def test_runs_of_frames_change_nothing(monkeypatch):
    payload = np.random.default_rng(1).integers(0, 256, 64 * 500, dtype=np.uint8).tobytes()
    whole = media.log_mel(payload)
    monkeypatch.setattr(media, "RUN", 7)
    parts = media.log_mel(payload)
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


def test_tone_lies_in_its_band():
    x = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)).astype(np.uint8)
    mels, _ = media.log_mel(x.tobytes())
    centre = media.mel_bank().argmax(axis=0)[int(mels.mean(axis=0).argmax())] * media.TO_RATE / media.FRAME
    assert abs(centre - 1000) < 120


def test_hysteresis():
    energy = np.array([-40.0] * 10 + [-30] * 3 + [-36] * 4 + [-40] * 10 + [-36] * 5 + [-20] * 2)
    assert media.segments(energy).tolist() == [[10, 17], [32, 34]]
