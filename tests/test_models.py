"""Models in the normaliser: asked once for each different word, and what they say against plain readings."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessitura.functions import words
from tessitura.plans import cascade, models

FULL = cascade.Rules(malay=lambda w: w.isin("tak", "makan"))


def noting(folder, model):
    """The model, which leaves a file for each value that it is asked."""

    def run(values):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(values))
        return [model(v) for v in values]

    return run


def noted(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().split("\n"))


def test_each_word_is_asked_once(spark, tmp_path):
    apart, stems = tmp_path / "apart", tmp_path / "stems"
    apart.mkdir(), stems.mkdir()
    segment = noting(str(apart), lambda w: w.replace("dan", " dan ").strip())
    stem = noting(str(stems), lambda w: next((r for r in ("jalan", "tulis", "ajar", "ra") if r in w), w))
    rows = [(i, f"{w} tak {v}") for i, (w, v) in enumerate([("jalanlah", "tulisnye"), ("ajar2", "menulis"), ("ikandanayam", "jalanlah"), ("belajarkn", "sera2")] * 20)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(6)
    got = {r["i"]: r["t"] for r in models.speak_with(df, "t", "i", FULL, segment=segment, stem=stem).collect()}
    want = ["jalanlah tak tulisnya", "ajar-ajar tak menulis", "ikan dan ayam tak jalanlah", "belajarkan tak sera-ra"] * 20
    assert [got[i] for i in range(len(rows))] == want
    assert noted(apart) == sorted({"jalanlah", "tulisnya", "ajar", "menulis", "ikandanayam", "belajarkn", "sera"})
    assert noted(stems) == sorted({"jalanlah", "tulisnya", "ajar", "menulis", "ikan", "dan", "ayam", "belajarkn", "sera"})


def test_without_models_nothing_changes(spark):
    df = spark.createDataFrame([(1, "xnak pergilah sekolah2 RM10"), (2, None), (3, "")], "i int, t string")
    plain = {r["i"]: r["t"] for r in cascade.speak(df, "t", FULL).collect()}
    assert {r["i"]: r["t"] for r in models.speak_with(df, "t", "i", FULL).collect()} == plain


def brute_affixes(word, stem):
    if any(word.endswith(w) for w in words.WHOLE):
        return word, "", word[:-1] if word[-1:].isdigit() else word
    digit = word[-1] if word[-1:].isdigit() else ""
    bare = word[: len(word) - len(digit)]
    low, s = bare.lower(), (stem or "").lower()
    if not s or s not in low:
        return word, "", bare
    a, parts = low.index(s), low.split(s)
    b = len(bare) - len(parts[-1])
    ending = words.ENDINGS.get(low[b:] if bare[b:] == low[b:] else bare[b:], bare[b:])
    return words.PREFIXES.get(bare[:a], bare[:a]) + bare[a:b] + digit, "lah" if ending in words.PARTICLES else ending, bare[a:b]


def test_affixes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        stem = "".join(rng.choice("aby(.") for _ in range(rng.randint(0, 4)))
        rows.append((rng.choice(["", "di", "terr", "mem", "x"]) + stem + rng.choice(["", "kn", "lah", "la", "nye", "q", "adalah"]) + rng.choice(["", "2", "33"]), rng.choice([stem, stem.upper(), "zz", None])))
    rows = [r for r in rows if r[0]]
    got = spark.createDataFrame(rows, "w string, s string").select("w", "s", words.without_affixes("w", "s").alias("p")).collect()
    for r in got:
        assert tuple(r["p"]) == brute_affixes(r["w"], r["s"]), r


def brute_runs(found, labels):
    out, held = [], []
    for w, label in [*zip(found, labels), (None, None)]:
        plain = w is not None and not (w[0] in "#@" or (w.upper() == w and w.lower() != w) or any(x in w.lower() for x in words.LAUGHS + words.SIGHS))
        if plain and label in models.IN_PHRASE:
            held.append((w, label))
            continue
        if held:
            out.append((" ".join(x for x, _ in held), any(k == models.FOREIGN for _, k in held)))
            held = []
        if w is not None:
            out.append((w, False))
    return out


def test_runs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        n = rng.randint(0, 12)
        rows.append(([rng.choice(["good", "day", "haha", "nasi", "MRT", "#x", "12", "aduh", "sir"]) for _ in range(n)], [rng.choice(["EN", "MS", "CAPITAL", "NOT_LANG", None]) for _ in range(n)]))
    got = spark.createDataFrame(rows, "w array<string>, k array<string>").select("w", "k", models.phrases(F.col("w"), F.col("k")).alias("p")).collect()
    for r in got:
        assert [tuple(x) for x in r["p"]] == brute_runs(r["w"], r["k"])


@pytest.mark.parametrize("limit", [models.BROADCAST_BYTES, 0])
def test_runs_are_translated_together(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(models, "BROADCAST_BYTES", limit)
    english = ["good", "morning", "see", "you"]
    label = lambda w: F.transform(w, lambda x: F.when(x.isin(english), "EN").when(x.rlike("^[0-9]+$"), "NOT_LANG").otherwise("MS"))
    translate = noting(str(tmp_path), lambda p: {"good morning": "selamat pagi", "see you 2": "jumpa lagi kamu 2"}.get(p, p))
    rows = [(1, "good morning semua see you 2 esok 3 4"), (2, "good morning"), (3, None), (4, ""), (5, "12 orang")]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    got = {r["i"]: r["t"] for r in models.translate_runs(df, "t", "i", label, translate).collect()}
    assert got == {1: "selamat pagi semua jumpa lagi kamu 2 esok 3 4", 2: "selamat pagi", 3: None, 4: "", 5: "12 orang"}
    assert noted(tmp_path) == ["good morning", "see you 2"]
