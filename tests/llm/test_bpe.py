"""Encoding equals that of the tokenizers library, and decoding its decode."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessitura.llm.bpe import BpeModel, bpe_decode, bpe_encode, vocabulary_path

THEIRS = Tokenizer.from_file(vocabulary_path())
OURS = BpeModel(vocabulary_path())


def encode(text):
    return [i for chunk in OURS.encode_batch([text])[0] for i in chunk[0]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert encode(text) == want and OURS.decode(want) == THEIRS.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["aaaaaaa aaaa", "<|endoftext|>a<|startoftext|> b", "ΑΣΣ Σας \x1cx　y", "it's I'LL", "", " ", "1234 ²", "z" * 5000])
def test_chosen_texts(text):
    assert encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, ids string")
    rows = sorted(map(tuple, bpe_encode(df, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    ids = THEIRS.encode("Hello world", add_special_tokens=False).ids
    full = (1, 2, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert rows == sorted([full, (2, 0, empty, empty), (2, 0, empty, empty), (None, 0, empty, empty)], key=str)
    assert bpe_encode(df.limit(0)).count() == 0
    whole = bpe_encode(df)
    assert [r["decoded"] for r in bpe_decode(whole.where("doc_id = 1")).collect()] == ["hello</w> world</w>"]


def test_what_is_remembered_is_bounded(monkeypatch):
    from tessitura.llm import bpe

    monkeypatch.setattr(bpe, "CACHED_CHARACTERS", 2000)
    ours = BpeModel(vocabulary_path())
    long = "日本" * 2000
    for k in range(200):
        text = f"{long}{k} word{k} other"
        assert [i for chunk in ours.encode_batch([text])[0] for i in chunk[0]] == THEIRS.encode(text, add_special_tokens=False).ids
    assert sum(map(len, ours.chunks)) + sum(map(len, ours.older)) < 5000
