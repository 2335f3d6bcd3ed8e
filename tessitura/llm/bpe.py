"""Byte-pair encoding and decoding of text columns against a published vocabulary file.

The vocabulary is a ``tokenizers`` JSON file: byte-level BPE with ``</w>`` word ends, NFC, collapsed white
space and lower case. Encoding works on all new words of an Arrow batch at once. Their symbols stand in one
array with links to the neighbours, and a *pair occurrence index* maps each mergeable pair to all its
positions. Pairs are applied in ascending rank, each to all its positions together; only the lists of the
pairs that touch a merged symbol change. Words seen before come from a cache of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from tessitura.llm.common import map_batches, table

#: Fixed values of the vocabulary file's pre-tokeniser, and the white space of its normaliser.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that Python splits at and the normaliser doesn't take for white space.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters whose class and case are the same in all editions of Unicode that matter; for others the library's own normaliser and splitter are asked.
SETTLED = re.compile("[\x00-\u052f\u2010-\u2027\u2030-\u205e]*+")
#: Words in a generation of the cache; two generations are kept, and what is met again moves to the younger one.
CACHED_WORDS = 250_000
#: Characters of remembered chunks at which the younger generation becomes the older one, and of the longest chunk that is remembered at all.
CACHED_CHARACTERS, LONGEST = 8 << 20, 256

#: A run without white space as encoded: its ids, their number, the ids in decimal and the tokens.
Chunk = tuple[tuple[int, ...], int, str, str]
_models: dict[str, BpeModel] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class BpeModel:
    """A vocabulary with its merges, and the cache of encoded words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.tokens}
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        self.of_last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left, self.right = keys >> 32, keys & 0xFFFFFFFF
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(PIECES.pattern), "removed", invert=True)
        self.cached_words = CACHED_WORDS
        self.chunks: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}
        self.held, self.long = 0, []

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of words (already normalised pieces), merged together through a pair occurrence index."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        if not raw:
            return []
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.of_byte[data]
        symbol[ends - 1] = self.of_last[data[ends - 1]]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[(ends - lengths)] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            rank = self.rank(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(part)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a)]
            nxt = after[at]
            ok = nxt >= 0
            at, nxt = at[ok], nxt[ok]
            ok = symbol[nxt] == b
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:  # overlapping pairs: from the left, every other one of a run
                keep, taken = np.ones(len(at), bool), -1
                for i, (p, q) in enumerate(zip(at.tolist(), nxt.tolist())):
                    keep[i] = p != taken
                    taken = q if keep[i] else -1
                at, nxt = at[keep], nxt[keep]
            if not len(at):
                continue
            symbol[at] = self.made[r]
            alive[nxt] = False
            beyond = after[nxt]
            after[at] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = at[linked]
            left = before[at]
            enter(np.unique(np.concatenate((left[left >= 0], at[linked]))))
        ids = symbol[alive].tolist()
        counts = np.add.reduceat(alive, ends - lengths).tolist()
        out, start = [], 0
        for c in counts:
            out.append(tuple(ids[start : start + c]))
            start += c
        return out

    def pieces(self, chunks: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each chunk with its normalised pieces. Settled chunks are normalised together, a line each: no line feed is in or composes with them."""
        settled, unsettled = [], []
        for c in chunks:
            (settled if c.isascii() or SETTLED.fullmatch(c) else unsettled).append(c)
        low = unicodedata.normalize("NFC", "\n".join(settled)).replace("Σ", "σ").lower().split("\n")
        for c, x in zip(settled, low):
            yield c, [x] if x.isalpha() else PIECES.findall(x)
        for c in unsettled:
            yield c, [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(c))]

    def learn(self, texts: list[list[str]]) -> None:
        """See that the younger generation of the cache has all chunks (runs without white space) of the texts."""
        if len(self.chunks) > self.cached_words or self.held > CACHED_CHARACTERS:
            self.older, self.chunks, self.held = self.chunks, {}, 0
        chunks, older, tokens, decimal = self.chunks, self.older, self.tokens, self.decimal
        new = set().union(*texts) - chunks.keys()
        again = new & older.keys()
        chunks.update((c, older[c]) for c in again)
        self.long = [c for c in new if len(c) > LONGEST]
        self.held += sum(map(len, new)) - sum(map(len, self.long))
        pieces = list(self.pieces(list(new - again)))
        distinct = list({p for _, ps in pieces for p in ps})
        words = dict(zip(distinct, self.encode_words(distinct)))
        for c, ps in pieces:
            ids = words[ps[0]] if len(ps) == 1 else tuple(chain.from_iterable([words[p] for p in ps]))
            if len(ids) == 1:
                chunks[c] = (ids, 1, decimal[ids[0]], tokens[ids[0]])
            else:
                chunks[c] = (ids, len(ids), " ".join([decimal[i] for i in ids]), " ".join([tokens[i] for i in ids]))

    def split(self, text: str | None) -> list[str]:
        """The chunks of a text; the strings of special tokens are chunks of their own."""
        if not text:
            return []
        if self.at_special and any(s in text for s in self.special):
            out = []
            for part in self.at_special.split(text):
                out += ["\0" + part] if part in self.special else self.split(part)
            return out
        return [c for c in SPACE.split(text) if c] if NOT_SPACE.search(text) else text.split()

    def encode_batch(self, texts: list[str | None]) -> list[list[Chunk]]:
        """For each text its chunks that have ids. Nothing here makes cycles, so the collector pauses instead of going through the cache again and again."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if was:
                gc.enable()

    def _encode_batch(self, texts: list[str | None]) -> list[list[Chunk]]:
        split = [self.split(t) for t in texts]
        marked = any(x in t for t in texts if t for x in ("\0", *self.special))  # only then a chunk may stand for a special token
        self.learn([[c for c in s if not c.startswith("\0") or c[1:] not in self.special] for s in split] if marked else split)
        for s, i in self.special.items():
            self.chunks["\0" + s] = ((i,), 1, str(i), s)
        found = self.chunks.__getitem__
        out = [[e for e in map(found, s) if e[1]] for s in split]
        for c in self.long:  # used in this batch, not remembered
            del self.chunks[c]
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, special ones included, joined by blanks: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def model(path: str) -> BpeModel:
    """The model of a file, read once for each Python worker."""
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded"), cached_words: int = CACHED_WORDS) -> DataFrame:
    """Encode each whole text and decode it again.

    ``outputs`` chooses columns: ``ids`` (array of int), ``decoded``, ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by a blank) and ``decoded_sha256``. A null or empty text gives no ids, an empty decoded text and
    their digests; a null id stays null; repeated rows are repeated. Texts are independent rows in one scan:
    there is no shuffle, and no two tasks share anything. ``cached_words`` bounds what a worker remembers.
    """
    path = path or vocabulary_path()
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        columns: dict[str, list] = {k: [] for k in outputs}
        bpe = model(path)
        bpe.cached_words = cached_words
        for row in bpe.encode_batch(texts):
            for k in outputs:
                if k == "ids":
                    value = list(chain.from_iterable(map(itemgetter(0), row)))
                elif k == "n_tokens":
                    value = sum(map(itemgetter(1), row))
                else:
                    value = " ".join(map(itemgetter(2 if k == "ids_sha256" else 3), row))
                    if k != "decoded":
                        value = hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()
                columns[k].append(value)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[k], kinds[k][1]) for k in outputs)], ["doc_id", *outputs])

    return map_batches(df.select(id_col, text_col), run, ", ".join([f"doc_id {id_type}", *(f"{k} {kinds[k][0]}" for k in outputs)]), rows=1024)


def bpe_decode(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Decode arrays of ids; null gives null, ids that the vocabulary lacks are left out."""
    path = path or vocabulary_path()
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if ids is None else model(path).decode(ids) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return map_batches(df.select(id_col, ids_col), run, f"doc_id {id_type}, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of all documents."""
    return bpe_encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
