"""Sounds: fades of real width, rates against pure tones and against one part, spectra there and back."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import arrays, signals
from tessitura.operators import sound


def wav_of(samples, rate, channels=1, bits=16):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(bits // 8), w.setframerate(rate)
        scaled = np.round(np.asarray(samples) * (2 ** (bits - 1) - 1)).astype(np.int64) + (128 if bits == 8 else 0)
        w.writeframes(b"".join(int(v).to_bytes(bits // 8, "little", signed=bits > 8) for v in scaled.reshape(-1)))
    return out.getvalue()


def test_crossfade_of_real_width(spark):
    rng = np.random.default_rng(1)
    rows = [([float(x) for x in rng.normal(size=n)], [float(x) for x in rng.normal(size=m)]) for n, m in ((480, 480), (480, 240), (1, 5), (0, 3), (2, 2))]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").coalesce(1).select("a", "b", arrays.crossfade("a", "b").alias("f")).collect()
    for r in got:
        n = min(len(r["a"]), len(r["b"]))
        ramp = 0.5 * (1 - np.cos(np.pi * np.linspace(0, 1, n)))
        assert np.allclose(r["f"], np.array(r["a"][:n]) * (1 - ramp) + np.array(r["b"][:n]) * ramp)
    assert spark.createDataFrame([(None, [1.0])], "a array<double>, b array<double>").select(arrays.crossfade("a", "b").alias("f")).first()["f"] is None


def put_together(rows):
    rows = sorted(rows, key=lambda r: r["part"])
    out = []
    for r in rows:
        assert r["start"] == len(out) and r["rate"] == 16000 and r["error"] is None
        out += r["samples"]
    return np.array(out)


@pytest.mark.parametrize("rate", [8000, 16000, 22050, 24000, 44100, 48000])
def test_tones_and_parts(spark, rate):
    n = rate // 2
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    files = spark.createDataFrame([("a", bytearray(wav_of(tone, rate)))], "path string, content binary")
    whole = put_together(sound.resample_files(files, "path", "content").collect())
    parts = put_together(sound.resample_files(files, "path", "content", part=1000).collect())
    assert len(whole) == -(-n * 16000 // rate) and (whole == parts).all()
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(whole)) / 16000)
    assert np.abs(whole - want)[200:-200].max() < 2e-4


def test_what_is_above_the_new_band_goes(spark):
    high = 0.5 * np.sin(2 * np.pi * 10_000 * np.arange(24000) / 24000)
    files = spark.createDataFrame([("a", bytearray(wav_of(high, 24000)))], "path string, content binary")
    assert np.abs(put_together(sound.resample_files(files, "path", "content").collect()))[200:-200].max() < 1e-3


def test_formats_and_broken_files(spark):
    x = np.linspace(-0.9, 0.9, 100)
    stereo = np.stack((x, x[::-1]), axis=1)
    listed = wav_of(x, 16000)
    listed = listed[:12] + b"LIST" + (5).to_bytes(4, "little") + b"hello\0" + listed[12:]
    floats = wav_of(x, 16000)[:20] + (3).to_bytes(2, "little") + wav_of(x, 16000)[22:34] + (32).to_bytes(2, "little") + b"data" + (400).to_bytes(4, "little") + x.astype("<f4").tobytes()
    good = {"8": wav_of(x, 16000, bits=8), "16": wav_of(x, 16000), "24": wav_of(x, 16000, bits=24), "32": wav_of(x, 16000, bits=32), "listed": listed, "float": floats, "cut": wav_of(x, 16000)[:-100]}
    rows = [*good.items(), ("stereo", wav_of(stereo, 16000, 2)), ("empty", b""), ("null", None), ("riff", b"RIFF\0\0\0\0WAVE"), ("odd", wav_of(x, 16000)[:34] + (12).to_bytes(2, "little") + wav_of(x, 16000)[36:]), ("raw", b"\0\x40" * 30)]
    got = {}
    for r in sound.resample_files(spark.createDataFrame([(k, v and bytearray(v)) for k, v in rows], "path string, content binary"), "path", "content").collect():
        got[r["path"]] = r
    for name in good:
        assert np.allclose(got[name]["samples"], x[: len(got[name]["samples"])], atol=2e-2 if name == "8" else 1e-4) and len(got[name]["samples"]) == (50 if name == "cut" else 100)
    assert np.allclose(got["stereo"]["samples"], 0, atol=1e-4)
    assert "empty" not in got and "null" not in got and got["riff"]["error"] == "no samples" and got["odd"]["error"] == "format 1 with 12 bits"
    assert len(got["raw"]["samples"]) == 20


def test_spectra_there_and_back(spark):
    rng = np.random.default_rng(3)
    sounds = {k: rng.normal(size=640) for k in ("a", "b")}
    frames = [(k, i, [float(v) for v in x[i * 16 : i * 16 + 64]]) for k, x in sounds.items() for i in range((640 - 64) // 16 + 1)]
    df = spark.createDataFrame(frames, "clip string, k int, s array<double>")
    back = sound.inverse_spectra(sound.spectra(df, "clip", "k", "s"), "clip", "k", "re", "im", 64)
    # the spectra already have the window once: adding up frames under it once more divides by its square
    rows = signals.overlap_add(back, "clip", "k", "samples", 16, 64).collect()
    assert len(rows) > 1000
    assert max(abs(r["value"] - sounds[r["clip"]][r["at"] + 24]) for r in rows) < 1e-9


def test_spectra_of_any_width_and_nulls(spark):
    x = [0.5, -1.0, 2.0, 0.25, 3.0, 1.0]
    f = np.fft.rfft(x)
    rows = [(1, 0, [float(v) for v in f.real], [float(v) for v in f.imag]), (1, 1, None, [0.0]), (1, 2, [6.0], [0.0])]
    got = {r["k"]: r["samples"] for r in sound.inverse_spectra(spark.createDataFrame(rows, "c int, k int, re array<double>, im array<double>"), "c", "k", "re", "im", 6).collect()}
    assert np.allclose(got[0], x) and got[1] is None and np.allclose(got[2], [1] * 6)
    assert sound.spectra(spark.createDataFrame([(1, 1, None), (1, 2, [])], "c int, k int, s array<double>"), "c", "k", "s").where(F.col("re").isNotNull()).count() == 0
