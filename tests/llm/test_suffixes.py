from __future__ import annotations

import bisect
import hashlib
import random

import numpy as np
import pytest

from tessitura.llm import suffixes


def brute(docs, length):
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_index_equals_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(15):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(4)]
        text = b"\xff".join(b"".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(6)) + b"\xff"
        x = np.frombuffer(text, np.uint8)
        index = suffixes.RunLengthIndex(x)
        ends = [i for i, b in enumerate(text) if b == 255]
        end = [ends[bisect.bisect_left(ends, i)] for i in range(len(text))]
        order = sorted(range(len(text)), key=lambda i: (text[i : end[i]] + b"\xff", end[i]))
        assert index.sorted(x).tolist() == order
        statistics = index.matching_statistics()
        for a, b in zip(order, order[1:]):
            n = 0
            while text[a + n] == text[b + n] != 255:
                n += 1
            assert statistics[b] == n
        before = index.suffix_before(np.array(order[1:]))
        assert before.tolist() == order[:-1]


def test_index_of_a_repetitive_text_is_small():
    rng = random.Random(9)
    part = bytes(rng.choice(b"abcdefgh") for _ in range(2000))
    text = np.frombuffer(b"\xff".join([part] * 200) + b"\xff", np.uint8)
    index = suffixes.RunLengthIndex(text)
    assert len(index.firsts) < len(text) / 100
    assert index.repeats(100)[:2001].sum() == 0 and index.repeats(100)[2001:].sum() == 199 * 1901


@pytest.mark.parametrize(("batch", "frequent"), [(7, 1000), (10_000, 1000), (7, 1), (10_000, 5)])
def test_random_repeats(spark, batch, frequent, monkeypatch):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    monkeypatch.setattr(suffixes, "INDEXED", 3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 900))) for _ in range(6)]
    docs = []
    for i in range(150):
        body = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 4))]
        docs.append((i, "".join(body)))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, "x" * 700), (203, "ab" * 400), (204, "x" * 99), (205, "x" * 100), (206, None), (207, "")]
    rng.shuffle(docs)
    got = results(suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(docs, 100)


def test_data_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert results(suffixes.remove_repeats(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 100)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).count() == 0
    rows = [(1, "q" * 150 + "r" * 150), (1, "q" * 150 + "r" * 150), (None, "r" * 150)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, doc int")
    got = sorted((str(r["doc_id"]), r["n_removed"], bytes(r["kept"])) for r in suffixes.remove_repeats(df, keep_text=True).collect())
    # the document without an id comes first: its own repeats go, and those of the others
    assert got[-1] == ("None", 149, b"r") or got[-1][0] == "None"
    assert got[0] == got[1] and got[0][0] == "1"


def test_anchors_are_where_equal_strings_have_them():
    rng = random.Random(4)
    middle = bytes(rng.choice(b"abc") for _ in range(400))
    places = []
    for left in (b"", b"zz" * 40, b"abc" * 99):
        text = left + middle + left[::-1]
        found = {}
        for h, first, last, _ in suffixes.anchors(text):
            for a, p, q in zip(h.tolist(), first.tolist(), last.tolist()):
                found.update({s: a for s in range(p, q + 1)})
        assert sorted(found) == list(range(len(text) - 99))
        places.append([found[len(left) + k] for k in range(300)])
    assert places[0] == places[1] == places[2]
