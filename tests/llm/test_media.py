from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pytest

from tessitura.llm import media


def brute_resize(pixels, rows, cols):
    h, w = pixels.shape
    big = np.kron(pixels.astype(float), np.ones((rows, cols)))
    return big.reshape(rows, h, cols, w).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 64), (7, 5), (64, 64), (3, 200)])
def test_area_resize(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert np.allclose(media.area_resize(pixels, 8, 9), brute_resize(pixels, 8, 9))


def test_formats_round_trip():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    assert (media.decode_media(media.encode_bmp(grey)) == grey).all() and (media.decode_media(media.encode_bmp(colour)) == colour).all()
    assert (media.decode_media(b"P5 # note\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode_media(b"P6\n3 4\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode_media(b"P2\n7 5\n255\n" + b" ".join(str(x).encode() for x in grey.reshape(-1))) == grey).all()
    assert media.decode_media(b"P1\n3 2\n101\n010").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode_media(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode_media(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]


def test_tiles(spark):
    grey = np.arange(64, dtype=np.uint8).reshape(8, 8)
    df = spark.createDataFrame([(1, media.encode_bmp(grey)), (2, b"nonsense"), (3, None), (4, b"P5\n8 8\n255\n" + grey.tobytes())], "id long, media binary")
    rows = {r["id"]: r for r in media.media_tiles(df, side=4).collect()}
    tile = np.load(io.BytesIO(bytes(rows[1]["tile"])))
    assert tile.shape == (4, 4) and rows[1]["dhash"] == rows[4]["dhash"] == "f" * 16 and rows[2]["error"] and rows[3]["error"]


def brute_hash(pixels):
    grid = np.round(brute_resize(pixels, 8, 9), 6)
    return "".join("1" if grid[r, c] < grid[r, c + 1] else "0" for r in range(8) for c in range(8))


def test_feature_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [(i, "".join(chr(x) for x in rng.integers(32, 1000, n))) for i, n in enumerate([0, 1, 63, 64, 65, 500, 2000])]
    for r in media.store_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        raw = dict(texts)[r["doc_id"]].encode()
        pixels = np.frombuffer(raw + bytes(-len(raw) % 64 if raw else 64), np.uint8).reshape(-1, 64)
        assert r["feature"] == f"{int(brute_hash(pixels), 2):016x}"
        tile = np.clip(np.rint(np.round(brute_resize(pixels, media.TILE, media.TILE), 9)), 0, 255).astype(np.uint8)
        out = io.BytesIO()
        np.save(out, tile)
        assert np.abs(np.load(io.BytesIO(media.npy_tile(pixels))).astype(int) - tile).max() <= 1


def test_samples_are_scaled(spark):
    files = [b"P5\n1 1\n65535\n\x03\xe8", b"P2\n1 1\n15\n15", b"P1\n2 2\n0000", b"P4\n8 1\n\xff", b"P2\n1 1\n0\n0"]
    df = spark.createDataFrame(list(enumerate(files)), "id long, media binary")
    rows = {r["id"]: r for r in media.media_tiles(df, side=1).collect()}
    assert [int(np.load(io.BytesIO(bytes(rows[i]["tile"])))[0, 0]) for i in range(4)] == [4, 255, 255, 0]


def test_payloads(spark):
    texts = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 64), (4, "x" * 64), (None, "y" * 5000)]
    rows = media.store_texts(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n_bytes int")).collect()
    assert len(rows) == 6
    for r in rows:
        text = dict(texts)[r["doc_id"]] or ""
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_pgm(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
