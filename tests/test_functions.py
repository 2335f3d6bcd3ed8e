"""Functions against stated inputs and outputs, many in one job each."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tessitura.functions import arrays, chinese, dates, numbers, references, signals, text, words
from tessitura.operators import metrics, tokens
from tessitura.plans import normalizer


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}").coalesce(1)
    return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (numbers.cardinal_ms, {
        "0": "kosong", "1": "satu", "10": "sepuluh", "11": "sebelas", "15": "lima belas", "21": "dua puluh satu", "100": "seratus",
        "111": "seratus sebelas", "1000": "seribu", "1001": "seribu satu", "1001000": "satu juta satu ribu", "1.5": "satu perpuluhan lima",
        "-3": "negatif tiga", "abc": "abc", "12,345": "dua belas ribu tiga ratus empat puluh lima",
        "1" + "0" * 35: "seratus decillion",
    }),
    (numbers.cardinal_en, {"0": "zero", "21": "twenty one", "123": "one hundred and twenty three", "1001": "one thousand and one", "1234": "one thousand, two hundred and thirty four", "2.5": "two point five"}),
    (numbers.ordinal_ms, {"1": "pertama", "12": "kedua belas", "x": "x"}),
    (numbers.ordinal_en, {"1": "first", "21": "twenty-first", "112": "one hundred and twelfth", "30": "thirtieth"}),
    (numbers.ordinal, {"3": "ketiga", "ke-3": "ketiga", "ke-IV": "keempat", "XII": "yang kedua belas", "ke-C": "ke-C"}),
    (numbers.cardinal_zh, {"0": "零", "10": "十", "105": "一百零五", "1005": "一千零五", "10010": "一万零一十", "100000005": "一亿零五", "110": "一百一十", "-3.5": "负三点五"}),
    (numbers.roman_to_int, {"IV": 4, "MCMXCIV": 1994, "ABC": -1, "IIX": 1}),
    (lambda c: numbers.money(c)["spoken"], {"RM10.5": "sepuluh ringgit lima puluh sen", "RM50.00": "lima puluh ringgit kosong sen", "50 sen": "lima puluh sen", "RM1.2 juta": "satu juta dua ratus ribu ringgit", "£5": "lima pound", "USD 5": "lima dollar", "abc": "abc"}),
    (lambda c: numbers.money(c)["canonical"], {"RM10.5": "RM10.5", "50 sen": "RM0.5", "$10.4K": "$10400", "abc": None}),
    (numbers.unit_words, {"5kg": "lima kilogram", "10MB": "sepuluh megabait", "2 mb": "dua megabit", "7 xyz": "tujuh xyz"}),
    (numbers.shortform, {"1.5k": "1500", "2 juta": "2000000", "x": "x"}),
    (numbers.words_to_number, {"seribu dua ratus tiga puluh empat": 1234, "sebelas": 11, "foo": None, "ribu": None}),
    (dates.time_words, {"2:01pm": "pukul dua satu minit pagi", "7 malam": "pukul tujuh malam", "25:00": "25:00"}),
    (dates.date_words, {"1/11/2021": "sebelas Januari dua ribu dua puluh satu", "25/12/2025": "dua puluh lima Disember dua ribu dua puluh lima", "x": "x"}),
    (dates.year_words, {"1998": "sembilan belas sembilan puluh lapan", "2000": "dua ribu", "1066": "seribu enam puluh enam", "2005": "dua puluh lima"}),
    (text.expand_contractions, {"I can't": "I cannot", "CAN'T": "Cannot", "She's": "She is"}),
    (text.unpack_contractions, {"don't Im wont": "do not I am will not"}),
    (text.pronounce, {"dr MSC 5G U.S.": "doctor M S C five G U S."}),
    (text.range_words, {"3-5 kg": "tiga hingga lima kg", "012-1234567 lain": "012-1234567 lain", "1.5-2 kg": "1.5-2 kg"}),
    (text.sanitize_markdown, {"# **b** _i_ a_b_c [l](u) `c` ~~s~~ <b>t</b>": "b i a_b_c l c s t", "```x\ny```z": "z", "plain": "plain"}),
    (text.normalize_plain, {"Hello; (world)! a-b": "Hello, world, a b.", "": ".", "x.": "x.", None: None}),
    (text.fix_spacing, {'say " hi " ( there ) , ok .': 'say "hi" (there), ok.'}),
    (text.case_name, {"Hello World": "title", "hello": "lower", "HELLO": "upper", "hELLO": "as is", "12": "as is"}),
    (text.squash_runs, {"bestttt": "bestt", "good": "good"}),
    (chinese.money_zh, {"RM10.50": "十令吉五十仙", "5k ringgit": "五千令吉"}),
    (chinese.date_zh, {"2021-03-04": "二零二一年三月四日"}),
    (chinese.time_zh, {"3:05pm": "下午三点五分"}),
    (tokens.sentences, {"Dr. Ali went home. He slept well.": ["Dr. Ali went home.", "He slept well."], "See www.a.com now. Version 3.5 is out.": ["See www.a.com now.", "Version 3.5 is out."]}),
    (tokens.speech_codes, {"<|s_1|><|s_23|><|s_": [1, 23]}),
    (tokens.unfinished, {"<|s_1|><|s_": "<|s_", "": ""}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_stated_values(spark, case):
    function, expected = CASES[case]
    assert values(spark, function, list(expected)) == list(expected.values())


def test_chinese_steps(spark):
    df = spark.createDataFrame([("我有RM10.50和3kg，36.5C，50%",), ("没有",), (None,)], "t string")
    assert [r["t"] for r in chinese.normalize_chinese(df, "t").collect()] == ["我有十令吉五十仙和三公斤，摄氏三十六点五度，百分之五十", "没有", None]


def test_segment_cascade(spark):
    df = spark.createDataFrame([("harga RM5.50 dan 3kg pada 10%",), ("hubungi 012-3456789",), ("",), (None,)], "t string")
    got = [r["t"] for r in normalizer.normalize_segment(df, "t").collect()]
    assert got == ["harga lima ringgit lima puluh sen dan tiga kilogram pada sepuluh peratus", "hubungi kosong satu dua, tiga empat lima enam tujuh lapan sembilan", "", None]


def test_relative_dates(spark):
    df = spark.createDataFrame([("3 hari lalu",), ("esok",), ("2 minggu depan",), ("x",)], "t string")
    day = datetime.date(2024, 3, 1)
    got = [r[0] for r in df.select(dates.relative_date("t", F.lit(day))).collect()]
    assert got == [datetime.date(2024, 2, 27), datetime.date(2024, 3, 2), datetime.date(2024, 3, 15), None]


def test_sound_bytes(spark):
    import io
    import wave

    row = spark.range(1).select(arrays.wav(F.array(F.lit(0), F.lit(-1), F.lit(32767))).alias("w")).select("w", arrays.wav_seconds("w").alias("s"), arrays.wav_header(None).alias("h")).first()
    with wave.open(io.BytesIO(bytes(row["w"]))) as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels(), w.readframes(3)) == (3, 24000, 1, b"\x00\x00\xff\xff\xff\x7f")
    assert row["s"] == 3 / 24000 and bytes(row["h"])[4:8] == b"\xff\xff\xff\x7f" and len(row["h"]) == 44


def test_crossfade_of_a_constant(spark):
    ones = F.array(*[F.lit(2.5)] * 9)
    got = spark.range(1).select(arrays.crossfade(ones, ones).alias("x"), arrays.ramp(F.lit(3)).alias("r")).first()
    assert all(abs(x - 2.5) < 1e-12 for x in got["x"]) and [round(x, 6) for x in got["r"]] == [0.0, 0.5, 1.0]
    assert arrays.crossfade_width(12, 10, 75) == 288


def test_codes_round_trip(spark):
    df = spark.range(0, 65536, 997).select(F.col("id").cast("int").alias("c"))
    assert df.where(arrays.digits_code(arrays.code_digits("c")) != F.col("c")).count() == 0


def test_percentiles(spark):
    v = F.array(*[F.lit(float(i)) for i in range(1, 11)])
    row = spark.range(1).select(metrics.bench_percentile(v, 50), metrics.bench_percentile(v, 99), metrics.stress_percentile(v, 0.95), metrics.stress_percentile(v, 0.05), metrics.bench_percentile(F.array().cast("array<double>"), 50)).first()
    assert list(row) == [6.0, 10.0, 9.0, 10.0, None]


def test_numbers_round_trip(spark):
    df = spark.range(0, 3_000_000, 7919)
    back = numbers.words_to_number(numbers.cardinal_ms(F.col("id").cast("string")))
    assert df.where(~back.eqNullSafe(F.col("id"))).count() == 0


WORD_CASES = [
    (lambda c: words.without_ending(c)["stem"], {"bukulah": "buku", "makankn": "makan", "adalah": "adalah", "xyz": "xyz", "diala2": "dia2", "": ""}),
    (words.spoken_title, {"Dr": "Doktor", "dr": "dr", "Ali": "Ali"}),
    (lambda c: words.squash_words(c), {"bestttt 1000 www.aaa.com": "bestt 1000 www.aaa.com"}),
    (lambda c: words.multireplace(c, {"a": "b", "b": "a", "ab": "x"}), {"aabb": "bxa"}),
    (lambda c: words.replace_phrases(c, {"tak nak": "tidak mahu"}), {"saya Tak nak pergi": "saya tidak mahu pergi", "tak nakal": "tak nakal"}),
    (words.is_punctuation, {"!": True, "-": False, "a": False}),
    (references.unescape_html, {"a &amp;lt; b &lt; c&nbsp;d": "a &lt; b < c\xa0d"}),
]


@pytest.mark.parametrize("case", range(len(WORD_CASES)))
def test_words(spark, case):
    function, expected = WORD_CASES[case]
    assert values(spark, function, list(expected)) == list(expected.values())


def test_variants():
    assert {"haih", "hhaaiihh", "haiih", "haaih"} <= set(words.variants("haih"))


def test_trim_at_crossing(spark):
    df = spark.createDataFrame([([1.0] * 10 + [-1.0] * 3,), ([1.0] * 13,), ([1.0, -1.0],)], "s array<double>")
    assert [len(r[0]) for r in df.select(signals.trim_at_crossing("s", margin=5)).collect()] == [9, 13, 2]
