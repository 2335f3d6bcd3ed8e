"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, and written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessitura.llm.common import map_batches, table, text_bytes

#: Width in samples of the pictures that hold payloads, and the sides of tiles and of the grid under the hash.
WIDTH, TILE, HASH_ROWS, HASH_COLS = 64, 16, 8, 9
HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s")


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A binary grey map of ``width`` columns that holds the payload's bytes as samples."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of uint8 or uint16, rows x columns, x 3 for colour; bit maps become 0 and 1 (1 is black)."""
    kind = data[1:2]
    if kind in b"14":
        m = re.match(rb"P([14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    else:
        m = HEADER.match(data)
    if not m or data[:1] != b"P":
        raise ValueError("not a Netpbm picture")
    w, h = int(m[2]), int(m[3])
    body = data[m.end() :]
    if kind == b"1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", body), np.uint8) - ord("0")
        return bits[: w * h].reshape(h, w)
    if kind == b"4":
        rows = np.frombuffer(body, np.uint8, h * ((w + 7) // 8)).reshape(h, -1)
        return np.unpackbits(rows, axis=1)[:, :w]
    most, planes = int(m[4]), 3 if kind in b"36" else 1
    if kind in b"23":
        flat = np.array(re.sub(rb"#[^\n]*", b"", body).split()[: w * h * planes], np.uint16)
        flat = flat if most > 255 else flat.astype(np.uint8)
    else:
        flat = np.frombuffer(body, ">u2" if most > 255 else np.uint8, w * h * planes)
        flat = flat.astype(np.uint16) if most > 255 else flat
    return flat.reshape((h, w, 3) if planes == 3 else (h, w))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette for two axes, 24 bits for three."""
    h, w = pixels.shape[:2]
    bits = 24 if pixels.ndim == 3 else 8
    body = pixels[::-1, :, ::-1] if bits == 24 else pixels[::-1]
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * bits // 8] = body.reshape(h, -1)
    palette = b"" if bits == 24 else b"".join(bytes((i, i, i, 0)) for i in range(256))
    offset = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 2835, 2835, 0, 0) + palette + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8 (palette), 24 or 32 bits as grey (if the palette is grey) or RGB array."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP picture")
    offset, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, offset).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, offset - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
        return colours[rows][..., 0] if (colours == colours[:, :1]).all() else colours[rows]
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode_media(data: bytes) -> np.ndarray:
    """A Netpbm or BMP file by its first bytes."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey_scale(data: bytes, pixels: np.ndarray) -> np.ndarray:
    """The samples of a decoded file on the scale from 0 (black) to 255 (white): bit maps have 1 for black, maps their own largest value."""
    if data[:2] in (b"P1", b"P4"):
        return (1.0 - pixels) * 255
    most = int(HEADER.match(data)[4]) if data[:1] == b"P" else 255
    return pixels if most == 255 else pixels * (255 / most)


def area_resize(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over equal areas, in double precision, from the integral image at the areas' edges.

    The integral image is needed only at the rows where areas end. Those rows are summed band by band, so
    memory follows the width and the target, not the height. Between samples the integral is linear.
    """
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    h, w = grey.shape
    edges = np.linspace(0, h, rows + 1)
    integral = np.zeros((rows + 1, w))
    total, done = np.zeros(w), 0
    for i, y in enumerate(edges):
        whole = min(int(y), h)
        if whole > done:
            total = total + grey[done:whole].sum(axis=0, dtype=np.float64)
            done = whole
        integral[i] = total + (y - whole) * grey[whole] if whole < h else total
    across = np.concatenate((np.zeros((rows + 1, 1)), np.cumsum(integral, axis=1)), axis=1)
    x = np.linspace(0, w, cols + 1)
    at = np.minimum(x.astype(int), w - 1)
    corners = across[:, at] + (x - at) * (across[:, at + 1] - across[:, at])
    return np.diff(np.diff(corners, axis=0), axis=1) / (h / rows * w / cols)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each mean of an 8 x 9 grid is smaller than its right neighbour."""
    grid = np.round(area_resize(pixels, HASH_ROWS, HASH_COLS), 6)
    return int.from_bytes(np.packbits(grid[:, :-1] < grid[:, 1:]).tobytes(), "big")


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The picture resized to ``side`` x ``side`` grey samples, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_tiles(df: DataFrame, media_col: str = "media", id_col: str = "id", side: int = TILE) -> DataFrame:
    """Decode a binary column of Netpbm and BMP files: height, width, NPY tile and difference hash.

    Null and undecodable media give nulls and the reason in ``error``; repeated rows are repeated.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(1).to_pylist():
            try:
                pixels = grey_scale(data, decode_media(data))
                rows.append((*pixels.shape[:2], npy_tile(pixels, side), f"{difference_hash(pixels):016x}", None))
            except (ValueError, TypeError, IndexError, ZeroDivisionError, OverflowError, struct.error) as e:
                rows.append((None, None, None, None, str(e) or type(e).__name__))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "height", "width", "tile", "dhash", "error"])

    return map_batches(df.select(id_col, media_col), run, f"id {id_type}, height int, width int, tile binary, dhash string, error string")


def stored_payload(text: bytes | None) -> tuple:
    """What op9 returns of a text: it is stored as a grey map, and all but the length comes from the stored bytes."""
    raw = text or b""
    media = encode_pgm(raw + bytes(-len(raw) % WIDTH if raw else WIDTH))
    pixels = decode_media(media)
    back = pixels.tobytes()
    tile = npy_tile(pixels)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(pixels):016x}", hashlib.sha256(tile).hexdigest()


def store_texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store each whole text's UTF-8 bytes, padded with zeros to a multiple of 64, as a grey map 64 wide.

    A null text is an empty one: one row of zeros. Equal texts give equal values. No shuffle; memory follows
    the longest text.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    names = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "tile_sha256": "string"}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [stored_payload(b) for b in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64() if k == "bigint" else pa.string()) for i, k in enumerate(names.values()))], ["doc_id", *names])

    return map_batches(df.select(id_col, text_col), run, ", ".join([f"doc_id {id_type}", *(f"{k} {v}" for k, v in names.items())]))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as grey maps and read back."""
    return store_texts(table(spark, sf_dir, "documents"))
