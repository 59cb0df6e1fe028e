import hashlib
import zlib
import io

import numpy as np
import pytest

from quillstore.llm import media


def brute_resize(image, height, width):
    h, w = image.shape
    fine = np.kron(image.astype(float), np.ones((height, width)))
    return fine.reshape(height, h, width, w).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (64, 64), (7, 2)])
def test_round_trip_and_resize(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert np.allclose(media.area_resize(image, 4, 6), brute_resize(image, 4, 6))


def test_plain_and_colour_forms():
    assert media.decode(b"P1 # c\n2 2\n1 0\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P2\n2 1\n9\n3 9").tolist() == [[3, 9]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n300\n\x01\x02").tolist() == [[258]]
    bgr = b"BM" + np.array([62, 0, 54, 40, 1, 1, 1 | 24 << 16, 0, 4, 0, 0, 0, 0], "<u4").tobytes() + b"\x03\x02\x01\x00"
    assert media.decode(bgr).tolist() == [[[1, 2, 3]]]


def plain_resize(image, height, width):
    """Each sample's share of each input sample's area, summed one by one."""

    def shares(n, m):
        out = np.zeros((m, n))
        for i in range(m):
            low, high = i * n / m, (i + 1) * n / m
            for j in range(int(low), min(n, int(np.ceil(high)))):
                out[i, j] = max(0.0, min(high, j + 1) - max(low, j))
        return out / (n / m)

    return shares(image.shape[0], height) @ image.astype(float) @ shares(image.shape[1], width).T


def test_texts(spark):
    rows = [(1, "abc", "x"), (2, None, "x"), (3, "", "x"), (None, "é" * 5000, "x"), (1, "abc", "y"), (5, "long text " * 9000, "x")]
    got = media.text_media(spark.createDataFrame(rows, "doc_id long, text string, feature string")).collect()
    assert len(got) == 6
    for r, (i, text, _) in zip(got, rows, strict=True):
        data = (text or "").encode()
        payload = data + b"\0" * (64 if not data else -len(data) % 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (i, len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert media.decode(r.media).tobytes() == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(r.media) == len(payload) + len(b"P5\n64 %d\n255\n" % (len(payload) // 64))
        grid, tile = np.frombuffer(payload, np.uint8).reshape(-1, 64), np.load(io.BytesIO(r.tile))
        assert r.feature.split(":")[1] == hashlib.sha256(r.tile).hexdigest()[:16] and (tile == np.rint(plain_resize(grid, 8, 8))).all()
        small = np.rint(plain_resize(grid, 8, 9) * 1e6)
        bits = "".join("1" if small[y, x] < small[y, x + 1] else "0" for y in range(8) for x in range(8))
        assert r.feature.split(":")[0] == f"{int(bits, 2):016x}"
    assert got[0].feature == got[4].feature
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles(spark):
    image = np.arange(100, dtype=np.uint8).reshape(10, 10)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(image))), (2, bytearray(b"junk")), (3, None)], "media_id long, data binary")
    a, b, c = media.tiles(df, height=10, width=10).orderBy("media_id").collect()
    assert (np.load(io.BytesIO(a.tile)) == image).all() and a.dhash == "f" * 16
    assert b.error and c.error and b.tile is None
