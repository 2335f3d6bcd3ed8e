from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessitura.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
BITS = ["a", "b@c.de", "@", ".", "1.2.3.4", "256.1.1.1", "0255.1.1.001", "9807915762804490", "12", "+", "+1 (743) 555-3824", "(", " ", ")", "-", "é", "😀", "\n", "x_y.z", "_", "4111 1111-1111 1111", "0", "99", "a(at)b.com", ""]


def luhn(x):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(a, k, e) for a, _, k, e in sorted(out)]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "+1 (743) 555-3824 " * 900), (5003, "1" * 50_000), (5004, "a" * 50_000 + "@"), (5005, "1 " * 20_000), (5006, "a@b.c " * 2000)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in found.collect()}
    assert {i: brute(t) for i, t in rows} == got


def test_boosting_separates_and_calibrates():
    yes, no, both = 1 << 4 | 1 << 8, 1 << 9, 1 << 3
    model = pii.boost({yes: (0, 90), no: (80, 0), both: (40, 40)}, {yes: (0, 30), no: (30, 0), both: (15, 15)})
    score = lambda c: 1 / (1 + 2.718281828459045 ** -model.raw(c))
    assert score(yes) > 0.9 and score(no) < 0.1 and 0.3 < score(both) < 0.7
    assert score(both) < model.thresholds["digits"] <= score(yes) and model.thresholds["mail"] == model.thresholds["digits"]  # too few of its own: that of all families
    assert set(pii.boost({}, {}).thresholds.values()) == {2.0}
    assert pii.boost({1: (0, 50)}, {1: (0, 5)}).thresholds["mail"] == 2.0  # five examples prove nothing


def test_model_as_expression(spark):
    model = pii.boost({3: (1, 50), 512: (40, 2), 8: (9, 9)}, {3: (0, 50)})
    for cell in (3, 512, 8, 0):
        got = spark.range(1).select(model.score(F.lit(cell))).first()[0]
        assert abs(got - 1 / (1 + 2.718281828459045 ** -model.raw(cell))) < 1e-9


def people(n):
    rng = random.Random(8)
    for i in range(n):
        yield f"write to user{i}@example.com today"
        yield f"call us, phone +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} now"
        yield f"the host 10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)} is down"
        yield f"order {rng.randint(10**7, 10**8)} was sent, see item {rng.randint(1000, 9999)}-{rng.randint(100000, 999999)}"
        yield f"sold {rng.randint(100, 999)} 000 000 units and version {rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)} of it"


def test_added_spans_and_redaction(spark):
    rows = list(enumerate(people(400)))
    odd = {9001: ("mail joe (at) example (dot) com now", "mail [EMAIL] now"), 9002: ("reach ann@example.org", "reach [EMAIL]"), 9003: ("the host 10 . 20 . 30 . 40 is down", "the host [IP] is down"), 9004: ("joe(at)example.com", "[EMAIL]"), 9005: ("call us, phone 1 (743) 555-3824 now", "call us, phone [PHONE] now")}
    found = pii.find_pii(spark.createDataFrame(rows + [(k, v[0]) for k, v in odd.items()], "doc_id long, text string"), carry=("text",))
    got = {r["doc_id"]: r for r in found.withColumn("clean", pii.redact(found, "text", "spans")).collect()}
    assert {k: got[k]["clean"] for k in odd} == {k: v[1] for k, v in odd.items()}
    for i, text in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]] == brute(text)
        assert got[i]["spans"] == got[i]["base"], text  # numbers of orders, amounts and versions stay


def test_open_candidates_weigh_what_is_left():
    got = pii.weighed({1: [10, 0, 9], 2: [10, 5, 0], 3: [10, 9, 10], 4: [10, 0, 0]}, {1: [0, 0, 9], 2: [0, 5, 0], 3: [0, 9, 10]})
    assert {c: (round(n, 6), y) for c, (n, y) in got.items()} == {1: (1.0, 9), 2: (15.0, 0), 3: (14.0, 10), 4: (10.0, 0)}


def hidden(rng):
    """Personal data written to escape the patterns, and what looks like it but is none: (text, kind or None)."""
    card = [rng.randrange(10) for _ in range(15)]
    check = next(c for c in range(10) if luhn("".join(map(str, [*card, c]))))
    good, bad = ("".join(map(str, [*card, c])) for c in (check, (check + 1 + rng.randrange(9)) % 10))
    dots = lambda x: ".".join(x[i : i + 4] for i in range(0, 16, 4))
    octets = [str(rng.randrange(1, 255)) for _ in range(4)]
    large = [str(rng.randrange(300, 999)) for _ in range(4)]
    name = "".join(rng.choice("abcdefgh") for _ in range(7))
    return rng.choice([
        (f"{name} (at) example (dot) org", "email"), (f"{name}[at]mail.example.com", "email"), (" . ".join(octets), "ip"), ("(dot)".join(octets), "ip"), (dots(good), "card"), (good[:4] + "--" + good[4:8] + "--" + good[8:12] + "--" + good[12:], "card"),
        (dots(bad), None), (" . ".join(large), None), (bad[:4] + "--" + bad[4:8] + "--" + bad[8:12] + "--" + bad[12:], None),
    ])


def planted(spark, sf, every):
    """The given documents, with one hidden piece in a blank of every so-manieth; what was planted, and all added spans."""
    rng = random.Random(9)
    rows, pieces = [], {}
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        text = r["text"]
        if r["doc_id"] % every == 0 and " " in text:
            at = rng.choice([i for i, c in enumerate(text) if c == " "]) + 1
            piece, kind = hidden(rng)
            text = text[:at] + piece + " " + text[at:]
            pieces[r["doc_id"]] = (at, at + len(piece), kind)
        rows.append((r["doc_id"], text))
    added = []
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.array_except("spans", "base").alias("new")).collect():
        added += [(r["doc_id"], s["start"], s["end"], s["kind"]) for s in r["new"]]
    return pieces, added


def rates(pieces, added):
    """Recall over planted pieces, and precision of added spans: one is right if it covers a planted piece of its kind."""
    right = {d for d, a, b, k in added if d in pieces and pieces[d][2] == k and a <= pieces[d][0] + 2 and b >= pieces[d][1] - 2}
    real = [d for d, p in pieces.items() if p[2]]
    return len(right) / max(1, len(real)), sum(d in right for d, *_ in added) / max(1, len(added)), len(real), len(added)


def test_hidden_data_inside_given_documents(spark):
    recall, precision, real, added = rates(*planted(spark, "sf0.1", 40))
    print(f"hidden pieces {real}, added {added}, recall {recall:.2f}, precision {precision:.2f}")
    assert real > 100 and recall > 0.8 and precision > 0.9


def test_overlapping_redactions(spark):
    spans = "array(named_struct('start', 0, 'rank', 3, 'kind', 'card', 'end', 5), named_struct('start', 3, 'rank', 4, 'kind', 'phone', 'end', 8))"
    df = spark.createDataFrame([("0123456789",)], "t string").withColumn("s", F.expr(spans))
    assert df.select(pii.redact(df, "t", "s")).first()[0] == "[CARD]89"


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty).count() == 0
    twice = spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co")], "doc_id long, text string")
    assert [len(r["spans"]) for r in pii.find_pii(twice).collect()] == [1, 1]
