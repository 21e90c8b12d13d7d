import hashlib
import wave
import zlib
from collections import Counter
from io import BytesIO

import numpy as np
import pytest

from tarnwell.llm import audio
from tarnwell.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, media string, n_bytes string"
TEXTS = [(1, "hello " * 100), (2, "hello " * 100), (3, None), (4, ""), (5, "x"), (6, "é" * 96), (6, "é" * 96), (None, "no id"), (7, "long text with WORDS. " * 60000), (8, "\x00\x01 ende")]


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def test_round_trip_and_features(spark):
    got = audio.audio_features(table(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    texts = dict(TEXTS)
    for r in got:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["n_bytes"] == len(text)
        with wave.open(BytesIO(bytes(r["media"]))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 8000)
            samples = w.readframes(w.getnframes())
        assert samples.rstrip(b" ") == text.rstrip(b" ") and len(samples) % 192 == 0 and len(samples) - len(text) < 192 or not text
        assert len(samples) >= 192
        tensors = audio.from_tensors(bytes(r["tensors"]))
        assert tensors["log_mel"].type.shape == [audio.WINDOW, audio.MELS]
        ends = tensors["end_ms"].to_pylist()
        assert tensors["start_ms"].to_pylist()[1:] == ends[:-1]
        assert all(0 <= s["start_ms"] < s["end_ms"] <= ends[-1] for s in r["segments"])
    same = {bytes(r["tensors"]) for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1


def test_query_columns(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_audio"](spark, str(tmp_path)).collect()
    texts = dict(TEXTS)
    for r in got:
        text = (texts[r["doc_id"]] or "").encode()
        whole = text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))
        assert r["payload_bytes"] == len(whole) and r["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(whole[-16:]) and r["media_bytes"] == len(whole) + 44


def test_resampling_is_the_same_in_blocks():
    x = np.random.default_rng(2).normal(size=960).astype(np.float32)
    none = np.zeros(audio.TAPS, np.float32)
    whole = audio.resample(x, none, none)
    parts = [audio.resample(x[:480], none, x[480 : 480 + audio.TAPS]), audio.resample(x[480:], x[480 - audio.TAPS : 480], none)]
    assert np.allclose(np.concatenate(parts), whole, atol=1e-6)


def test_resampling_keeps_a_low_tone():
    t = np.arange(8000) / 8000
    none = np.zeros(audio.TAPS, np.float32)
    out = audio.resample(np.sin(2 * np.pi * 300 * t).astype(np.float32), none, none)
    assert len(out) == 6000
    spectrum = np.abs(np.fft.rfft(out))
    assert spectrum.argmax() == 300


def test_blocks_give_the_frames_of_the_whole(monkeypatch):
    text = np.random.default_rng(1).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    whole = audio.log_mel(text)
    monkeypatch.setattr(audio, "BLOCK", 192 * 4)
    parts = audio.log_mel(text)
    assert np.allclose(whole[0], parts[0], atol=1e-2) and len(whole[1]) == len(parts[1])


def test_spans_have_hysteresis():
    power = np.array([0, 0, 9, 5, 5, 0, 0, 9, 0, 5.0])
    assert audio.spans(power, high=4, low=1) == [(2, 5), (7, 8)]
    assert audio.spans(np.zeros(5)) == []


def test_wrong_files_are_refused():
    with pytest.raises(ValueError):
        audio.from_wav(audio.to_wav(b"x" * 192)[:-1])


def test_empty_table(spark):
    assert audio.audio_features(table(spark, []).limit(0)).count() == 0
