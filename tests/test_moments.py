"""Expressions of time against a plain reading by the same patterns, and moments against stated ones."""

from __future__ import annotations

import datetime
import random
import re

from pyspark.sql import functions as F

from tessitura.functions import moments
from tessitura.functions.dates import DATE_WORDS
from tessitura.plans import normalizer

NOW = datetime.datetime(2024, 3, 31, 15, 20, 10)
PIECES = [
    "10:30", "2021-01-05", "semalam", "malam", "3 hari lalu", "2 minggu lepas", "skrg ni", "dalam 3jam", "minggu depan", "esok", "pukul 8", "pkul 9.30 pagi", "5 Jan 2021", "12/5/2021", "Mac 7",
    "5 jam", "jam ini", "1:30", "11:30", "kata", "\n", ".", "7 thun dpn", "2.30pm", "01.02.2020", "dlm 4minit", "yesterday", "ptg", "tahun ni", "880101-01-1234", "é", "RM5", "3rd",
]


def brute(text):
    """The keys, by findall of every pattern and comparison of all pairs."""
    found = [m for pattern, _ in moments.KINDS.values() for m in re.findall(f"(?:{pattern})", text)]
    found += [m for a, b in moments.PAIRS for m in re.findall(f"(?:{moments.KINDS[a][0]}) (?:{moments.KINDS[b][0]})", text)]
    slang = re.compile("|".join(sorted(DATE_WORDS, key=len, reverse=True)))
    keys = {re.sub(" +", " ", slang.sub(lambda m: DATE_WORDS[m[0]], f.replace(".", ":"))).strip(" ") for f in found} - {""}
    return {k for k in keys if not any(k in other and k != other for other in keys)}


def test_expressions_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) + rng.choice([" ", " ", " ", "", "  ", ", "]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", moments.expressions("t").alias("k")).collect()
    assert sum(len(r["k"]) for r in rows) > 800
    for r in rows:
        assert len(r["k"]) == len(set(r["k"])) and set(r["k"]) == brute(r["t"]), r["t"]


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text rlike '[0-9]'").select("doc_id", F.concat("text", F.lit(" 3 hari lalu, 5 Jan 2021 pukul 8")).alias("text"))
    for r in docs.select("text", moments.expressions("text").alias("k")).collect():
        assert set(r["k"]) == brute(r["text"])


def test_longest_only(spark):
    rng = random.Random(2)
    keys = [["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    for compared in (0, 128):
        rows = spark.createDataFrame([(k,) for k in keys], "k array<string>").select("k", moments.longest_only(F.col("k"), compared).alias("m")).collect()
        for r in rows:
            assert set(r["m"]) == {x for x in r["k"] if not any(x in y and x != y for y in r["k"])}


MOMENTS = {
    "10:30": (2024, 3, 31, 10, 30), "10:30 PM": (2024, 3, 31, 22, 30), "12 AM": (2024, 3, 31), "12:05 PM": (2024, 3, 31, 12, 5), "5 jam": (2024, 3, 31, 5), "8:30pm": (2024, 3, 31, 20, 30), "25:00": None, "13 PM": (2024, 3, 31, 13),
    "2021-01-05": (2021, 1, 5), "1/12/2021": (2021, 1, 12), "25/12/2021": (2021, 12, 25), "31:12:2020": (2020, 12, 31), "2021-02-30": None, "5 Jan 2021": (2021, 1, 5), "Jan 5, 2021": (2021, 1, 5), "5 Mac 21": (2021, 3, 5),
    "5 Ogos 75": (1975, 8, 5), "Dis 7": (2024, 12, 7), "31 Feb": None, "3rd": None, "kata": None, "": None, None: None,
    "3 hari lalu": (2024, 3, 28, 15, 20, 10), "1 bulan lalu": (2024, 2, 29, 15, 20, 10), "2 tahun depan": (2026, 3, 31, 15, 20, 10), "minggu depan": (2024, 4, 7, 15, 20, 10), "jam lalu": (2024, 3, 31, 14, 20, 10), "90 minit lalu": (2024, 3, 31, 13, 50, 10),
    "dalam 3jam": (2024, 3, 31, 18, 20, 10), "dlm 30saat": (2024, 3, 31, 15, 20, 40), "2 jam depan": (2024, 3, 31, 17, 20, 10), "sekarang ini": (2024, 3, 31, 15, 20, 10), "tahun ni": (2024, 3, 31, 15, 20, 10), "jam ini": (2024, 3, 31, 15, 20, 10),
    "semalam": (2024, 3, 30, 15, 20, 10), "kelmarin": (2024, 3, 30, 15, 20, 10), "esok": (2024, 4, 1, 15, 20, 10), "10000 hari lalu": None, "99999999999999 hari lalu": None, "9999 tahun lalu": None,
    "semalam 10:30 PM": (2024, 3, 30, 22, 30), "pukul 8 esok": (2024, 4, 1, 8), "10:30 2021-01-05": (2021, 1, 5, 10, 30), "2021-01-05 10:30:15": (2021, 1, 5, 10, 30, 15), "pukul 9:30 AM 5 Jan 2021": (2021, 1, 5, 9, 30), "7 Mac pukul 21": (2024, 3, 7, 21),
}


def test_moments(spark):
    rows = spark.createDataFrame(list(enumerate(MOMENTS)), "i int, t string").withColumn("at", F.lit(str(NOW)).cast("timestamp"))
    got = {r["t"]: r["m"] for r in rows.select("t", F.date_format(moments.moment_of("t", "at"), "yyyy-MM-dd HH:mm:ss").alias("m")).collect()}
    assert got == {t: m and str(datetime.datetime(*m)) for t, m in MOMENTS.items()}


def test_entities_of_a_text(spark):
    texts = ["jumpa 10:30 2021-01-05, bayar RM10.50 semalam", None, "", "880101-01-1234"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    e = [r["e"] for r in rows.select("i", normalizer.entities("t", F.lit(str(NOW)).cast("timestamp")).alias("e")).orderBy("i").collect()]
    assert {k: str(v) for k, v in e[0]["dates"].items()} == {"10:30 2021-01-05": "2021-01-05 10:30:00", "semalam": "2024-03-30 15:20:10"}
    assert e[0]["money"] == {"RM10.50": "RM10.50"} or e[0]["money"] == {"RM10.50 ": "RM10.50"}
    assert e[1]["dates"] is None and e[2]["dates"] == e[3]["dates"] == {}
