"""The pipeline against its stages by brute force."""

from __future__ import annotations

import corpus_pipeline
from test_decontaminate import brute as brute_leaks
from test_pii import brute as brute_pii
from test_neardup import brute_similar
from tokenizers import Tokenizer

from tessitura.llm import registry
from tessitura.llm.bpe import vocabulary_path

DATA = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs if r["text"] and any(c.isalpha() for c in r["text"])]
    everything = [(r["doc_id"], r["text"]) for r in docs]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).collect()}
    assert kept == {i for i, root in brute_similar(everything, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY).items() if i == root}
    kept = {i for i, root in brute_similar(rows, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY).items() if i == root}
    rows = [(i, t) for i, t in rows if i in kept]
    leaked = {i for i, _ in brute_leaks(rows, items)}
    rows = [(i, t) for i, t in rows if i not in leaked]
    theirs = Tokenizer.from_file(vocabulary_path())
    want = {}
    for i, t in rows:
        out, at = "", 0
        for a, kind, e in brute_pii(t):
            if a >= at:
                out += t[at:a] + f"[{kind.upper()}]"
            at = max(at, e)
        want[i] = theirs.encode(out + t[at:], add_special_tokens=False).ids
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want


def test_stages_stand_edges(spark):
    df = spark.createDataFrame([(1, "the of and", "en", "s", 10), (2, None, None, None, None), (None, "the of", "en", "s", 6), (1, "the of and", "en", "s", 10), (3, "12 34", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DATA)
        assert out.count() <= df.count()
        assert stage(spark, df.limit(0), DATA).count() == 0
        if name != "encode":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, DATA).collect()} == {1, None}
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()) == ["1", "2", "3", "None"]


def test_rows_without_an_id_and_with_a_shared_one(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) > 8)
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    rows = [(5, long), (5, other), (7, long + " more"), (None, other + " more"), (None, "alone " + long[:200]), (None, "alone " + long[:200]), (9, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, DATA).collect()]
    assert sorted(kept, key=str) == sorted([(5, long), (5, other), (None, "alone " + long[:200]), (9, None)], key=str)
    leaky = [(None, f"before {item} after"), (None, long), (5, f"before {item} after"), (5, long), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in leaky], df.schema)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, df, DATA).collect()]
    assert sorted(left, key=str) == sorted([(None, long), (5, long), (None, None)], key=str)


def test_one_query_per_operator():
    assert [sum(name.startswith(f"op{n}_") for name in registry.QUERIES) for n in range(1, 11)] == [1] * 10 and "pipeline" in registry.QUERIES
