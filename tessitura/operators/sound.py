"""Sounds as rows of parts: reading WAV files, changing the sample rate, and spectra.

A file is cut into parts that carry some samples of their neighbours, so each part is worked on alone, wherever it lies, and the parts of a long
sound are spread over tasks. What comes out of parts is the same, sample by sample, as what comes out of the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessitura.functions.arrays import RATE

#: Samples of a part, without those of its neighbours.
PART = 1 << 16
#: Zero crossings of the low-pass filter on either side, and the share of the band that it lets through.
CROSSINGS, ROLLOFF = 32, 0.95
#: The formats of a WAV's samples: (code, bits) and how numpy reads them, with the divisor and the value of silence.
FORMATS = {(1, 8): ("u1", 128.0, 128), (1, 16): ("<i2", 32768.0, 0), (1, 32): ("<i4", 2147483648.0, 0), (3, 32): ("<f4", 1.0, 0), (3, 64): ("<f8", 1.0, 0)}
PARTS = "part int, start bigint, before int, rate int, samples array<float>, error string"


def wav_layout(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(format, channels, rate, bits, first byte, bytes) of a WAV's samples, whatever chunks it has; of a file without header that of 16-bit samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return 1, 1, RATE, 16, 0, len(data)
    number = lambda at, n: int.from_bytes(data[at : at + n], "little")
    at, shape = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], number(at + 4, 4)
        if name == b"fmt ":
            code = number(at + 8, 2)
            code = number(at + 32, 2) if code == 0xFFFE and size >= 40 else code  # the extended form names it further on
            shape = code, number(at + 10, 2), number(at + 12, 4), number(at + 22, 2)
        elif name == b"data":
            if not shape:
                raise ValueError("samples before their format")
            return *shape, at + 8, min(size, len(data) - at - 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav_samples(data: bytes, layout: tuple[int, int, int, int, int, int], first: int, last: int) -> np.ndarray:
    """The samples from ``first`` to ``last`` (exclusive) as numbers from -1 to 1, the mean of all channels."""
    code, channels, _, bits, at, _ = layout
    width = channels * bits // 8
    raw = data[at + first * width : at + last * width]
    if (code, bits) == (1, 24):
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        values = wide.reshape(-1).view("<i4") / 2147483648.0
    elif (code, bits) in FORMATS:
        kind, most, silence = FORMATS[code, bits]
        values = (np.frombuffer(raw, kind).astype(np.float64) - silence) / most
    else:
        raise ValueError(f"format {code} with {bits} bits")
    return values.reshape(-1, channels).mean(axis=1)


def reach(source: int, target: int) -> int:
    """Samples on either side of a place that the filter between two rates sees."""
    return math.ceil(CROSSINGS / (ROLLOFF * min(1.0, target / source)))


def sound_parts(files: DataFrame, key: str, content: str, target: int, part: int = PART) -> DataFrame:
    """(key, part, start, before, rate, samples, error): WAV files in parts of ``part`` samples with as many of both neighbours as resampling to ``target`` sees.

    ``samples`` begin ``before`` samples ahead of ``start``. Null and empty files have no parts; of a file that can't be read there is one row with its error.
    """
    kind = files.schema[key].dataType.simpleString()
    names = [key, "part", "start", "before", "rate", "samples", "error"]

    def parts(name: object, data: bytes) -> Iterator[tuple]:
        try:
            layout = wav_layout(data)
            channels, rate, bits, size = layout[1], layout[2], layout[3], layout[5]
            if not channels or not rate or not bits // 8:
                raise ValueError("no channels, rate or bits")
            total, side = size // (channels * (bits // 8)), reach(rate, target)
            for k, start in enumerate(range(0, total, part)):
                first = max(0, start - side)
                yield name, k, start, start - first, rate, wav_samples(data, layout, first, min(total, start + part + side)).astype(np.float32), None
        except ValueError as bad:
            yield name, 0, 0, 0, None, None, str(bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                data = batch.column(1)[i].as_py()
                for row in parts(batch.column(0)[i], data) if data else ():
                    yield pa.RecordBatch.from_arrays([pa.array([row[0].as_py()], batch.column(0).type), *(pa.array([v], t) for v, t in zip(row[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string())))], names)

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {PARTS}")


def filter_table(source: int, target: int) -> np.ndarray:
    """The polyphase filter: a row of taps for each place between two samples that a new sample can have. Every row sums to one, so silence and constants stay."""
    up, down = target // math.gcd(source, target), source // math.gcd(source, target)
    cut, side = ROLLOFF * min(1.0, up / down), reach(source, target)
    away = np.arange(1 - side, side + 1)[None, :] - np.arange(up)[:, None] / up
    taps = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / side, -1, 1)))
    return taps / taps.sum(axis=1, keepdims=True)


def resampled_part(samples: np.ndarray, start: int, before: int, count: int, source: int, target: int, taps: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of the first new sample that lies in a part, and all new samples of it. Beyond the ends of a sound there is silence."""
    up, down = target // math.gcd(source, target), source // math.gcd(source, target)
    side = taps.shape[1] // 2
    first, last = -(-start * up // down), -(-(start + count) * up // down)
    padded = np.concatenate((np.zeros(2 * side), samples.astype(np.float64), np.zeros(2 * side)))
    out = np.empty(last - first)
    for a in range(0, last - first, 4096):  # some at a time, so that the gathered samples stay few
        n = np.arange(first + a, min(last, first + a + 4096))
        at, phase = n * down // up, n * down % up
        rows = (at - start + before + side + 1)[:, None] + np.arange(2 * side)[None, :]
        out[a : a + len(n)] = (padded[rows] * taps[phase]).sum(axis=1)
    return first, out


def resampled(parts: DataFrame, key: str, target: int, part: int = PART) -> DataFrame:
    """(key, part, start, rate, samples, error) at ``target`` samples a second; ``start`` counts new samples. Rows with an error pass."""
    names = [key, "part", "start", "rate", "samples", "error"]
    kind = parts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            starts, outs = [], []
            for i in range(batch.num_rows):
                start, before, rate = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                if rate is None:
                    starts.append(0)
                    outs.append(None)
                    continue
                samples = batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                if rate == target:
                    first, out = start, samples[before : before + part]
                else:
                    if rate not in tables:
                        tables[rate] = filter_table(rate, target)
                    first, out = resampled_part(samples, start, before, min(part, len(samples) - before), rate, target, tables[rate])
                starts.append(first)
                outs.append(out.astype(np.float64))
            rates = pa.array([None if r is None else target for r in batch.column(4).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), rates, pa.array(outs, pa.list_(pa.float64())), batch.column(6)], names)

    return parts.select(key, "part", "start", "before", "rate", "samples", "error").mapInArrow(run, f"`{key}` {kind}, part int, start bigint, rate int, samples array<double>, error string")


def resample_files(files: DataFrame, key: str, content: str, target: int = 16_000, part: int = PART) -> DataFrame:
    """WAV files at another rate, as parts; the parts are dealt evenly before the work."""
    return resampled(sound_parts(files, key, content, target, part).repartition(key, "part"), key, target, part)


def inverse_spectra(frames: DataFrame, key: str, number: str, re: str, im: str, width: int) -> DataFrame:
    """(key, number, samples): the real signal of ``width`` samples that each half spectrum (``width / 2 + 1`` bins in two arrays) stands for.

    Missing bins are zero, and further ones are cut. Null spectra give null.
    """
    bins = width // 2 + 1
    kinds = [frames.schema[c].dataType.simpleString() for c in (key, number)]

    def matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), bins))
        for to, i in enumerate(rows):
            own = column[int(i)].values.to_numpy(zero_copy_only=False)[:bins]
            out[to, : len(own)] = own
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(np.array(batch.column(2).is_valid()) & np.array(batch.column(3).is_valid()))
            found = np.fft.irfft(matrix(batch.column(2), known) + 1j * matrix(batch.column(3), known), width, axis=1) if len(known) else np.zeros((0, width))
            out: list[np.ndarray | None] = [None] * batch.num_rows
            for i, samples in zip(known.tolist(), found):
                out[i] = samples
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], [key, number, "samples"])

    return frames.select(key, number, re, im).mapInArrow(run, f"`{key}` {kinds[0]}, `{number}` {kinds[1]}, samples array<double>")


def spectra(frames: DataFrame, key: str, number: str, samples: str) -> DataFrame:
    """(key, number, re, im): the half spectrum of each frame under a periodic Hann window."""
    kinds = [frames.schema[c].dataType.simpleString() for c in (key, number)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                x = batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(np.float64) if batch.column(2)[i].is_valid else None
                found.append(None if x is None or not len(x) else np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x)))))
            parts = [pa.array([None if f is None else part(f) for f in found], pa.list_(pa.float64())) for part in (np.real, np.imag)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *parts], [key, number, "re", "im"])

    return frames.select(key, number, samples).mapInArrow(run, f"`{key}` {kinds[0]}, `{number}` {kinds[1]}, re array<double>, im array<double>")
