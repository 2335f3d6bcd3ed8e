"""Sample arrays: ramps, crossfades, padding, trimming, PCM and WAV bytes, codec codes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.rewriting import Text, col, let

RATE, SAMPLES_PER_CODE, FRAME = 24_000, 480, 320
#: Size fields of a WAV header whose length is not known when it is sent.
OPEN_RIFF = 0x7FFFFFFF


def ramp(n: Text) -> Column:
    """``n`` values of a raised cosine from 0 to 1."""
    n = col(n)
    steps = F.greatest(n - 1, F.lit(1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(0.5) * (1 - F.cos(F.lit(math.pi) * i / steps)))).otherwise(F.array().cast("array<double>"))


def crossfade(before: Text, after: Text) -> Column:
    """The end of one array faded into the start of the next over the shorter length. Both arrays and the ramp are made once a row."""

    def fade(s: Column) -> Column:
        n = F.least(F.size(s["a"]), F.size(s["b"]))
        pairs = F.zip_with(F.slice(s["a"], F.lit(1), n), F.slice(s["b"], F.lit(1), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.zip_with(pairs, ramp(n), lambda p, r: p["x"] * (1 - r) + p["y"] * r)

    return let(F.struct(col(before).alias("a"), col(after).alias("b")), fade)


def crossfade_width(ms: int, context: int, chunk: int, rate: int = RATE) -> int:
    """Samples of a crossfade, bounded by the context and half a chunk."""
    return max(2, min(rate * ms // 1000, context * SAMPLES_PER_CODE, chunk * SAMPLES_PER_CODE // 2))


def clip(samples: Text) -> Column:
    return F.transform(col(samples), lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))))


def pcm16(samples: Text) -> Column:
    """16-bit integers: clipped, scaled by 32767, cut towards zero."""
    return F.transform(clip(samples), lambda x: (x * 32767).cast("int"))


def little_endian(value: Column, size: int) -> Column:
    """The lowest ``size`` bytes of an integer as hexadecimal digits, the lowest first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(size)))


def pcm_bytes(values: Text) -> Column:
    """16-bit integers as little-endian bytes."""
    return F.unhex(F.array_join(F.transform(col(values), lambda v: little_endian(v, 2)), ""))


def wav_header(data_bytes: Column | None, rate: int = RATE) -> Column:
    """44 bytes of a mono 16-bit WAV; without a length, the header of a stream."""
    riff = F.lit(OPEN_RIFF) if data_bytes is None else data_bytes + 36
    size = F.lit(OPEN_RIFF - 36) if data_bytes is None else data_bytes
    text = lambda s: F.lit(s.encode().hex().upper())
    fmt = [F.lit(16), F.lit(1), F.lit(1), F.lit(rate), F.lit(rate * 2), F.lit(2), F.lit(16)]
    sizes = [4, 2, 2, 4, 4, 2, 2]
    return F.unhex(F.concat(text("RIFF"), little_endian(riff, 4), text("WAVEfmt "), *(little_endian(v, n) for v, n in zip(fmt, sizes)), text("data"), little_endian(size, 4)))


def wav(values: Text) -> Column:
    """A whole WAV file of 16-bit integers."""
    return F.concat(wav_header(F.size(col(values)) * 2), pcm_bytes(values))


def field_at(data: Column, start: int, size: int) -> Column:
    """An unsigned little-endian integer inside bytes."""
    byte = lambda i: F.conv(F.hex(F.substring(data, start + i + 1, 1)), 16, 10).cast("long")
    out = byte(0)
    for i in range(1, size):
        out = out + byte(i) * (1 << 8 * i)
    return out


def wav_seconds(data: Text) -> Column:
    """Duration of a WAV file, of raw PCM if it has no header, 0 of nothing."""
    data = col(data)
    head = F.substring(data, 1, 4) == F.lit(b"RIFF")
    return F.when(head, field_at(data, 40, 4) / (field_at(data, 28, 4))).otherwise(F.floor(F.length(data) / 2) / RATE)


def pad_to(values: Text, length: Column) -> Column:
    """Zeros at the end up to ``length``."""
    values = col(values)
    return F.concat(values, F.array_repeat(F.lit(0).cast("int"), F.greatest(length - F.size(values), F.lit(0))))


def frame_padding(n: Text) -> Column:
    """Samples that fill the last frame; a whole frame if it is full already."""
    return F.lit(FRAME) - col(n) % FRAME


def bucket(length: Text, buckets: list[int]) -> Column:
    """The smallest bucket that holds a length, else the length itself."""
    length = col(length)
    fits = F.filter(F.array(*map(F.lit, sorted(buckets))), lambda b: b >= length)
    return F.coalesce(F.get(fits, 0), length)


def zero_crossings(samples: Text) -> Column:
    """The positions before which the sign changes."""
    s = col(samples)
    signs = F.transform(s, lambda x: x < 0)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(F.get(signs, i) != F.get(signs, i - 1), F.lit(False)))


def rms(samples: Text) -> Column:
    s = col(samples)
    return F.sqrt(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")) / F.size(s))


def code_digits(code: Text) -> Column:
    """The eight base-4 digits of a codec code, the lowest first."""
    return F.array(*(F.shiftright(col(code), 2 * i).bitwiseAND(F.lit(3)) for i in range(8)))


def digits_code(digits: Text) -> Column:
    return F.aggregate(F.reverse(col(digits)), F.lit(0), lambda acc, d: acc * 4 + d)
