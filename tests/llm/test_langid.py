from __future__ import annotations

import random
import zlib
from collections import Counter

from tessitura.llm import langid


def brute(text):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    s = f" {' '.join(words)} " if words else ""
    out = Counter()
    for n in (1, 2, 3):
        for g in (s[i : i + n] for i in range(len(s) - n + 1)):
            if g != " " and not (n == 3 and g[1] == " "):
                key = 0
                for c in g:
                    key = key << 21 | ord(c)
                out[key] += 1
    return dict(out)


def test_counts_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(1)
    for size in (3, 5, 7, 1 << 18):
        monkeypatch.setattr(langid, "AT_ONCE", size)
        for _ in range(200):
            text = "".join(rng.choice("abÉ ß1.\nΣ  İ日") for _ in range(rng.randint(0, 40)))
            grams, counts = langid.counted(langid.ngrams(langid.slices(text)))
            assert dict(zip(grams.tolist(), counts.tolist())) == brute(text)


def test_distance():
    p = langid.Profiles({"a": langid.document_profile("abab abab").tolist(), "b": langid.document_profile("xyz xyz").tolist()})
    assert p.nearest("abab abab") == ("a", 1.0) and p.nearest("xyz")[0] == "b" and p.nearest("12 34") == ("und", 0.0) and p.nearest(None) == ("und", 0.0)


def test_choice_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    counts: dict[str, Counter] = {}
    for r in docs:
        if r["text"] and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts.setdefault(r["lang"], Counter()).update(brute(r["text"]))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]
    profiles = {k: {g: i for i, g in enumerate(order(c))} for k, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.identify_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    for r in docs:
        own = order(Counter(brute(r["text"] or "")))
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not own:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        far = {k: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - (1 - far[best] / (langid.PROFILE * len(own)))) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify_languages(docs, carry=("doc_id", "lang")).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, "der und die", "de"), (3, "the and of", "en"), (4, None, "de"), (5, "", None), (None, "the of", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify_languages(df).collect()}
    assert got[4]["lang_pred"] == "und" and got[5]["lang_pred"] == "und" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify_languages(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(df.where("lang is null")).collect()} == {"und"}
