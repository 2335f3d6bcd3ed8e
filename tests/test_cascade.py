"""What the cascade says of stated texts, in Malay and English, as a service asks for it and with all rules."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tessitura.operators import tokens
from tessitura.plans import cascade
from tessitura.plans.normalizer import normalize_different, normalize_text

# --- Fixed values: texts and how they are read (Malay, English; None: not stated) ---------------------------
SERVICE = {
    "email saya ialah husein.zol05@gmail.com": ("email saya ialah HUSEIN dot ZOL kosong lima di GMAIL dot COM", "email saya ialah HUSEIN dot ZOL zero five at GMAIL dot COM"),
    "husein.zol05@gmail.com": ("HUSEIN dot ZOL kosong lima di GMAIL dot COM", "HUSEIN dot ZOL zero five at GMAIL dot COM"),
    "https://huseinhouse.com": ("HTTPS huseinhouse dot com", "HTTPS huseinhouse dot com"),
    "012-1234567": ("kosong satu dua, satu dua tiga empat lima enam tujuh", "zero one two, one two three four five six seven"),
    "hubungi 012-1234567": ("hubungi kosong satu dua, satu dua tiga empat lima enam tujuh", "hubungi zero one two, one two three four five six seven"),
    "880101-14-5678": ("lapan lapan kosong satu kosong satu satu empat lima enam tujuh lapan", "eight eight zero one zero one one four five six seven eight"),
    "RM10": ("sepuluh ringgit", None),
    "RM10.5": ("sepuluh ringgit lima puluh sen", "ten ringgit fifty sen"),
    "RM99.99": ("sembilan puluh sembilan ringgit sembilan puluh sembilan sen", None),
    "harga RM10.5": ("harga sepuluh ringgit lima puluh sen", "harga ten ringgit fifty sen"),
    "$10.5": ("sepuluh dollar lima puluh cent", "ten dollar fifty cent"),
    "1015 sen": ("sepuluh ringgit lima belas sen", None),
    "2:01pm": ("pukul dua satu minit pagi", "at two one minute am"),
    "2AM": ("pukul dua pagi", "at two am"),
    "61.2%": ("enam puluh satu perpuluhan dua peratus", "sixty one point two percent"),
    "100%": ("seratus peratus", "one hundred percent"),
    "36.5c": ("tiga puluh enam perpuluhan lima celsius", "thirty six point five celcius"),
    "suhu 36.5c": ("suhu tiga puluh enam perpuluhan lima celsius", None),
    "61.2kg": ("enam puluh satu perpuluhan dua kilogram", "sixty one point two kilogram"),
    "100g": ("seratus gram", "one hundred gram"),
    "10km": ("sepuluh kilometer", "ten kilometer"),
    "2.5l": ("dua perpuluhan lima liter", "two point five liter"),
    "250ml": ("dua ratus lima puluh milliliter", None),
    "500mb": ("lima ratus megabit", "five hundred megabits"),
    "01234": ("kosong satu dua tiga empat", "zero one two three four"),
    "A12345678": ("A satu dua tiga empat lima enam tujuh lapan", "A one two three four five six seven eight"),
    "1/11/2021": ("sebelas Januari dua ribu dua puluh satu", "eleven January two thousand and twenty one"),
    "pada 25 Disember 2023 nanti": ("pada dua puluh lima Disember dua ribu dua puluh tiga nanti", "pada twenty five December two thousand and twenty three nanti"),
    "harga $3bn": ("harga tiga bilion dollar", "harga three billion dollar"),
    "mesyuarat pukul 2:01pm": ("mesyuarat pukul dua satu minit pagi", None),
    "10 meters": ("sepuluh meters", None),
    "sejam": ("sejam", "sejam"),
    "a@b.com dan c@d.com": ("A di B dot COM dan C di D dot COM", None),
    "#2023 @ali": ("#2023 @ali", "#2023 @ali"),
    "ABC-12-X": ("A B C sempang satu dua sempang X", "A B C dash one two dash X"),
    "Ali2 pergi": ("Ali dua pergi", "Ali two pergi"),
    "don't go": ("do not go", "do not go"),
    "": ("", ""),
}
FULL = {
    "ke-1": ("pertama", "first"), "ke-21": ("kedua puluh satu", "twenty-first"), "ke-100": ("keseratus", "one hundredth"), "ke-XXI": ("kedua puluh satu", None), "ke-XII": ("kedua belas", None),
    "123": ("seratus dua puluh tiga", "one hundred and twenty three"), "10/4": ("sepuluh per empat", None), "1/2": ("satu per dua", None), "10x": ("sepuluh kali", "ten times"), "100x": ("seratus kali", None),
    "tahun 2024": ("tahun dua puluh dua puluh empat", None), "tahun 1999": ("tahun sembilan belas sembilan puluh sembilan", None), "tahun 2000": ("tahun dua ribu", None), "tahun 1945": ("tahun sembilan belas empat puluh lima", None),
    "tahun 1990-an": ("tahun sembilan belas sembilan puluhan", None), "pada 15/3": ("pada lima belas hari bulan tiga", "on the fifteenth day of the third month"), "pada 1/12": ("pada satu hari bulan dua belas", None),
    "2011 - 2019": ("dua ribu sebelas hingga dua ribu sembilan belas", "two thousand and eleven until two thousand and nineteen"), "1445H": ("seribu empat ratus empat puluh lima Hijrah", None), "12hb": ("dua belas hari bulan", None),
    "besttt": ("best", None), "takkkkk": ("tak", None), "xkisah": ("tak kisah", None), "1.5k": ("seribu lima ratus", None), "Dr Ali": ("Doktor Ali", None), "kuala lumpur": ("Kuala lumpur", None), "nk makan": ("nak makan", None), "Nk": ("Nak", None), "3 January": (None, "third January"),
    "budak2": ("b u d a k dua", None), "jom2": ("jom-jom", None), "y": ("kenapa", None),
}


def said(spark, texts, rules):
    df = spark.createDataFrame([(i, en, t) for i, t in enumerate(texts) for en in (False, True)], "i int, en boolean, t string").coalesce(1)
    got = {(r["i"], r["en"]): r["t"] for r in cascade.speak(df, "t", rules, df["en"]).collect()}
    return {t: (got[i, False], got[i, True]) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("stated", "rules"), [
    (SERVICE, cascade.SERVICE),
    (FULL, cascade.Rules(english=lambda w: w.isin("best"), malay=lambda w: w.isin("tak", "makan"), place=lambda w: w.isin("kuala"), slang={"nk": "nak"})),
], ids=["service", "full"])
def test_stated_texts(spark, stated, rules):
    got = said(spark, list(stated), rules)
    wrong = {t: (got[t], want) for t, want in stated.items() if any(w is not None and g != w for g, w in zip(got[t], want))}
    assert not wrong


def test_what_rules_leave_alone(spark):
    off = cascade.Rules(text=False, word_rules=False, ic=False, phone=False, money=False, percent=False, units=False, time=False, number=False, cardinal=False, ordinal=False, until=False, fraction=False, times=False, date=False)
    texts = ["880101-14-5678", "012-1234567", "RM10", "61.2%", "10km", "2AM", "01234", "https://a.com", "x@y.com"]
    assert said(spark, texts, off) == {t: (t, t) for t in texts}
    scored = cascade.Rules(score=lambda w: w.rlike("^q").cast("double") * 0 + 1 - w.rlike("^q").cast("int"), cardinal=True)
    assert said(spark, ["q12 12"], scored)["q12 12"][0] == "q12 dua belas"


def test_sentences(spark):
    stated = {
        "Dr. Ali pergi ke Kuala Lumpur. Dia makan nasi!": ["Dr. Ali pergi ke Kuala Lumpur.", "Dia makan nasi!"],
        "Harga 3.50 ringgit. Lihat www.abc.com sekarang? Ya benar...": ["Harga 3.50 ringgit.", "Lihat www.abc.com sekarang?", "Ya benar..."],
        "satu baris\ndua baris": ["satu baris.", "dua baris."],
        'Dia kata "pergi." Saya diam saja.': ['Dia kata "pergi".', "Saya diam saja."],
        "No. 5 di Jan. 2020 bersama J. Doe dan Ph.D. lain.": ["No. 5 di Jan. 2020 bersama J. Doe dan Ph.D. lain."],
        "": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(stated)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", tokens.sentences("t").alias("s")).collect()}
    assert [got[i] for i in range(len(stated))] == list(stated.values())


def test_numbers_of_a_text_are_spoken_once(spark):
    """Time grows with the groups of a text, not with groups times numbers."""
    long = " ".join(f"RM{n}.50" for n in range(1000, 1400))
    df = cascade.speak(spark.createDataFrame([(long,)] * 32, "t string").repartition(4), "t")
    df._jdf.queryExecution().executedPlan()
    began = time.perf_counter()
    assert df.collect()[31][0].startswith("seribu ringgit lima puluh sen seribu satu ringgit lima puluh sen")
    took = time.perf_counter() - began
    assert took < 20, took


def test_different_texts_are_normalised_once(spark):
    rows = [(1, "RM12.50 pada 3/4/2021", True), (2, "RM12.50 pada 3/4/2021", False), (3, None, True), (4, "RM12.50 pada 3/4/2021", True), (5, "3-5 kg", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, t string, en boolean")
    once = normalize_different(df, "t", "en")
    assert once.columns == df.columns
    assert sorted(once.collect()) == sorted(normalize_text(df, "t", F.col("en")).collect())
    plan = once._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    sides = [plan.children().apply(i).toString() for i in (0, 1)]
    assert "Aggregate" in sides[1] and "regexp" not in sides[0]
