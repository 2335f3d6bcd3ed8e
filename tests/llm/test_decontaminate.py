from __future__ import annotations

from collections import Counter

import regex

from tessitura.llm.decontaminate import leaks


def words(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split()


def brute(docs, items, similarity=0.8):
    out = {}
    for item, text in items:
        w = words(text or "")
        k = min(5, len(w))
        if not w:
            continue
        own = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        m = sum(own.values())
        for doc, body in docs:
            d = words(body or "")
            s = [tuple(d[i : i + k]) for i in range(len(d) - k + 1)]
            for a in range(len(s)):
                win = Counter(s[a : a + m])
                common = sum((win & own).values())
                j = common / (sum(win.values()) + m - common)
                if j >= similarity:
                    out[doc, item] = max(out.get((doc, item), 0), j)
    return out


def test_data_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaks(docs, bench).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_planted(spark):
    item = " ".join(f"w{i}" for i in range(40))
    edited = item.replace("w20", "zz")
    docs = [(1, f"before {item} after"), (2, item.upper().replace(" ", ", ")), (3, f"x {edited} y"), (4, "w1 w2 w3 w4 w5 w6"), (5, None), (6, ""), (7, " ".join(item.split()[:38])), (8, "only four words here"), (9, "a a a a a a a a"), (1, f"before {item} after"), (10, "q" * 20000)]
    items = [(0, item), (1, None), (2, "only four words here"), (3, "..."), (4, "a a a a a a a")]
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaks(df, bench).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and {(1, 0), (2, 0), (7, 0), (8, 2), (9, 4)} <= set(got) and (4, 0) not in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0
