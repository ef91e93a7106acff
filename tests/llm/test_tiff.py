from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessella.llm import tiff


def images():
    g = np.random.default_rng(1)
    smooth = np.cumsum(g.integers(0, 3, (70, 90)), axis=1).astype(np.uint8)
    return [smooth, g.integers(0, 256, (1, 1)).astype(np.uint8), np.zeros((300, 200), np.uint8), g.integers(0, 60000, (33, 17)).astype(np.uint16), g.integers(0, 256, (40, 50, 3)).astype(np.uint8), g.integers(0, 256, (200, 300)).astype(np.uint8)]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_round_trip(scheme, predictor, tile, order):
    data = tiff.encode(images(), scheme, predictor, rows_per_strip=13, tile=tile, order=order)
    got = list(tiff.pages(data))
    assert len(got) == len(images())
    for i, (page, image) in enumerate(zip(got, images(), strict=True)):
        assert (page.number, page.height, page.width, page.compression, page.predictor, page.tiled) == (i, *image.shape[:2], scheme, predictor, bool(tile))
        assert (page.pixels.squeeze() == image.squeeze()).all() and page.pixels.dtype == image.dtype


def test_known_streams():
    assert tiff.unpack_bits(bytes.fromhex("FEAA02800 02AFDAA0380002A22F7AA".replace(" ", "")), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # Codes 256 7 258 8 8 258 257, the example of the format's description: 7 7 7 8 8 7 7.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 257))
    data = int(bits.ljust(64, "0"), 2).to_bytes(8, "big")
    assert tiff.lzw_decode(data, 7) == bytes([7, 7, 7, 8, 8, 7, 7])


@pytest.mark.parametrize("seed", range(5))
def test_codecs(seed):
    r = random.Random(seed)
    data = bytes(r.choices(range(r.choice([2, 5, 256])), k=r.choice([0, 1, 127, 128, 129, 60_000])))
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_broken_files():
    good = tiff.encode(images()[:1], tiff.DEFLATE)
    bad = [b"", b"II*\0", b"GIF89a..", good[:-6], good[:40], b"II*\0" + struct.pack("<I", 1 << 30), b"II*\0" + struct.pack("<IHI", 8, 0, 8)]
    for data in bad:
        with pytest.raises(tiff.TiffError):
            list(tiff.pages(data))


def test_page_rows(spark):
    two = tiff.encode(images()[:2], tiff.LZW)
    rows = spark.createDataFrame([("a", bytearray(two), 1), ("b", bytearray(b"junk"), 1), ("c", None, 1), ("a", bytearray(two), 1), (None, bytearray(two), 1)], "name string, media binary, page int")
    got = tiff.tiff_pages(rows, "name", "media").collect()
    assert sorted((r["name"] or "", r["page"] is None or r["page"]) for r in got) == [("", False), ("", 1), ("a", False), ("a", False), ("a", 1), ("a", 1), ("b", True), ("c", True)]
    assert {r["error"] for r in got} == {None, "not a TIFF file", "no file"}
    assert bytes(next(r["pixels"] for r in got if r["page"] == 0)) == images()[0].tobytes()


def test_media_digest(spark):
    texts = ["", None, "x", "y" * 64, "z" * 65, "é" * 400_000, "x", "a\0b"]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(None, "x", None)], "doc_id long, text string, feature string")
    rows = tiff.media_digest(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = tiff.payload_image(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2][1:] == got[6][1:] == got[None][1:]
    assert got[5]["n_pages"] == 4
    assert tiff.media_digest(docs.limit(0)).collect() == []
