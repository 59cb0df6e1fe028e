"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .text import per_text, texts

#: Payload bytes are padded to a positive multiple of this, the width of their image.
UNIT = 64
TILE = 64


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples as a binary Netpbm file."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def _netpbm_head(data: bytes) -> tuple[str, list[int], int]:
    """Kind, numbers of the header, and where the samples start; comments reach from # to the line's end."""
    kind, numbers, at = data[:2].decode("ascii", "replace"), [], 2
    while len(numbers) < (2 if kind in ("P1", "P4") else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n?)+(\d+)").match(data, at)
        if not m:
            raise ValueError("not a Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    return kind, numbers, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or, above 255 levels, uint16; grey images are (h, w), colour ones (h, w, 3). Bitmaps give 0 for black, 255 for white."""
    kind, numbers, at = _netpbm_head(data)
    w, h = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    shape = (h, w, 3) if kind in ("P3", "P6") else (h, w)
    count = int(np.prod(shape))
    if kind == "P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        return np.where(np.unpackbits(rows, axis=1)[:, :w] == 1, 0, 255).astype(np.uint8)
    if kind in ("P5", "P6"):
        return np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1).reshape(shape).astype(np.uint8 if top < 256 else np.uint16)
    if kind not in ("P1", "P2", "P3"):
        raise ValueError(f"unknown Netpbm kind {kind!r}")
    found = re.findall(rb"[01]" if kind == "P1" else rb"\d+", re.sub(rb"#[^\n]*", b"", data[at:]))[:count]
    if len(found) < count:
        raise ValueError("samples are missing")
    plain = np.array([int(x) for x in found], np.uint16).reshape(shape)
    return np.where(plain == 1, 0, 255).astype(np.uint8) if kind == "P1" else plain.astype(np.uint8 if top < 256 else np.uint16)


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey samples as an uncompressed BMP file with a grey palette."""
    h, w = samples.shape
    stride = -w % 4 + w
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    head = b"BM" + np.array([54 + 1024 + rows.size, 0, 54 + 1024, 40, w, h, 1 | 8 << 16, 0, rows.size, 2835, 2835, 256, 0], "<u4").tobytes()
    return head + palette.tobytes() + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel: (h, w) where the palette is grey, else (h, w, 3) in the order red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, size = (int.from_bytes(data[i : i + 4], "little") for i in (10, 14))
    w, h = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed, colours = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little"), int.from_bytes(data[46:50], "little")
    if packed or bits not in (1, 4, 8, 24, 32):
        raise ValueError("only uncompressed BMP files of 1, 4, 8, 24 or 32 bits")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)
    rows = rows if h < 0 else rows[::-1]
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = rows[:, :w]
    else:
        index = np.packbits(np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits), axis=2)[:, :w, 0] >> (8 - bits)
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    grey = bool((palette == palette[:, :1]).all())
    return palette[index][:, :, 0] if grey else palette[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Every output sample is the mean over its area of the input, fractions of samples included; float64, any input size above 0."""
    h, w = image.shape[:2]
    whole = np.zeros((h + 1, w + 1, *image.shape[2:]))
    whole[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)

    def at(edges: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
        low = np.minimum(edges.astype(int), n - 1)
        part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    rows = np.diff(at(np.linspace(0, h, height + 1), whole, h), axis=0)
    both = np.diff(at(np.linspace(0, w, width + 1), rows.swapaxes(0, 1), w), axis=0).swapaxes(0, 1)
    return both / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 areas is darker than its right neighbour."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    small = np.rint(area_resize(grey, 8, 9) * 1e6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = TILE, width: int = TILE) -> bytes:
    """The image resized to one tile, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, id_col: str = "media_id", data_col: str = "data", height: int = TILE, width: int = TILE) -> DataFrame:
    """media_id, height, width, tile (NPY bytes), dhash of each stored Netpbm or BMP file; error instead of these where it can't be decoded."""

    def rows(data):
        try:
            if data is None:
                raise ValueError("no data")
            image = decode(data)
            if not image.size:
                raise ValueError("no samples")
            return image.shape[0], image.shape[1], npy_tile(image, height, width), difference_hash(image), None
        except (ValueError, OverflowError, IndexError) as e:
            return None, None, None, None, str(e)

    schema = "doc_id long, height int, width int, tile binary, dhash string, error string"
    read = media.select(media[id_col].cast("long").alias("doc_id"), media[data_col].alias("text"))
    return read.mapInArrow(per_text(schema, rows, ["height", "width", "tile", "dhash", "error"]), schema).withColumnRenamed("doc_id", "media_id")


def text_payload(text: str | None) -> tuple[int, bytes]:
    """A text's number of UTF-8 bytes and these bytes padded with 0 to a positive multiple of UNIT; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def stored(text: str | None) -> tuple:
    """A text's payload as a grey PGM image of width 64, and what is found when these bytes are read back."""
    n, payload = text_payload(text)
    media = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))
    image = decode(media)
    back, tile = image.tobytes(), npy_tile(image, 8, 8)
    feature = f"{difference_hash(image)}:{hashlib.sha256(tile).hexdigest()[:16]}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, tile


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Every text stored as an image and read back: sizes, digests and feature; with_bytes adds media, the stored form, and its NPY tile.

    One row for each row: a null or empty text gives one line of zeros, repeated rows repeat, very long texts give tall images, an empty
    table gives none; other columns aren't read.
    feature is the difference hash and the start of the tile's digest, so equal texts have equal features.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary, tile binary" * with_bytes
    names = [x.split()[0] for x in schema.split(", ")][1:]
    return texts(docs, id_col, text_col).mapInArrow(per_text(schema, lambda text: stored(text)[: len(names)], names), schema)
