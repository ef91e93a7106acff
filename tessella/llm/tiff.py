"""TIFF media columns: write and read baseline images, one row a page.

``pages`` walks the chain of image directories of a file, in either byte order, decodes strips or
tiles held plain or by PackBits, LZW or deflate, undoes horizontal differencing, and gives the
samples of each page. ``encode`` writes such files, ``payload_image`` stores bytes in one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tags, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class TiffError(ValueError):
    """The file does not follow the format, or uses what this reader does not know."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, plain = bytearray(), 0, 0

    def literal(to: int) -> None:
        nonlocal plain
        while plain < to:
            n = min(128, to - plain)
            out.append(n - 1)
            out.extend(data[plain : plain + n])
            plain += n

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            literal(at)
            out += bytes([257 - run, data[at]])
            plain = at + run
        at += run
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, width, bits, held, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not before:
            entry = table[code] if code < len(table) else b""
            if not entry:
                raise TiffError("LZW data without a clear code")
        else:
            if code > len(table):
                raise TiffError("LZW code beyond the table")
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        out += entry
        before = entry
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, known, size = 9, b"", 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = known + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            known = longer
            continue
        put(known[0] if len(known) == 1 else table[known])
        table[longer] = size
        size += 1
        known = data[i : i + 1]
        if size == 4094:
            put(known[0])  # the decoder adds one entry more
            width = 12
            put(256)
            table, width, size, known = {}, 9, 258, b""
        else:
            width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
    if known:
        put(known[0] if len(known) == 1 else table[known])
        size += 1
        width = 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


_PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


def _unpack(scheme: int, data: bytes, size: int) -> bytes:
    if scheme == NONE:
        return data[:size]
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate data: {e}") from None
    raise TiffError(f"compression {scheme} is unknown")


def _undo(block: np.ndarray, predictor: int) -> np.ndarray:
    """Horizontal differencing (predictor 2): each sample is held less its left neighbour."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    raise TiffError(f"predictor {predictor} is unknown")


def _differ(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories. Raises TiffError on a broken file."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"

    def value(fmt: str, at: int) -> tuple:
        try:
            return struct.unpack_from(order + fmt, data, at)
        except struct.error:
            raise TiffError("the file ends early") from None

    (at,), seen, number = value("I", 4), set(), 0
    if not at:
        raise TiffError("no directory")
    while at:
        if at in seen:
            raise TiffError("the directories form a circle")
        seen.add(at)
        (n,) = value("H", at)
        tags: dict[int, tuple[int, ...]] = {}
        for entry in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = value("HHI", entry)
            if letter := TYPES.get(kind):
                place = entry + 8
                if not count:
                    raise TiffError("a tag without a value")
                if count * struct.calcsize(letter) > 4:
                    (place,) = value("I", place)
                if place + count * struct.calcsize(letter) > len(data):
                    raise TiffError("the file ends early")
                tags[tag] = value(f"{count}{letter}", place)
        (at,) = value("I", at + 2 + 12 * n)
        if WIDTH not in tags or HEIGHT not in tags:
            raise TiffError("a directory has no size")
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: B023, E731
        width, height, samples, bits, predictor, scheme = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), one(BITS, 1), one(PREDICTOR, 1), one(COMPRESSION, NONE)
        if bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1:
            raise TiffError(f"{bits} bits a sample are unknown")
        if one(PLANAR, 1) != 1:
            raise TiffError("separate planes are unknown")
        kind = np.dtype(np.uint8) if bits == 8 else np.dtype(np.uint16).newbyteorder(order)
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        offsets, sizes = (tags.get(TILE_OFFSETS, ()), tags.get(TILE_BYTES, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ()))
        if not across or not down:
            raise TiffError("blocks without a size")
        wide, high = -(-width // across), -(-height // down)
        if len(offsets) < wide * high or len(sizes) < wide * high:
            raise TiffError("blocks are missing")
        if width * height * samples * bits // 8 > 1 << 31:
            raise TiffError("a page of over 2 GiB")
        pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k in range(wide * high):
            y, x = k // wide * down, k % wide * across
            rows = down if tiled else min(down, height - y)
            size = rows * across * samples * kind.itemsize
            raw = _unpack(scheme, data[offsets[k] : offsets[k] + sizes[k]], size)
            if len(raw) < size:
                raise TiffError("a block is too short")
            block = _undo(np.frombuffer(raw, kind, rows * across * samples).reshape(rows, across, samples).astype(pixels.dtype), predictor)
            pixels[y : y + down, x : x + across] = block[: height - y, : width - x]
        yield Page(number, width, height, samples, bits, scheme, predictor, tiled, pixels)
        number += 1


def encode(images: Iterable[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of one page an image: arrays of 8 or 16 bits, height x width, or with samples last."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        if not image.size:
            raise TiffError("an image needs a pixel")
        across, down = tile[::-1] if tile else (width, min(rows_per_strip, height))
        offsets, sizes = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                block = image[y : y + down, x : x + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                held = _PACK[compression](_differ(block, predictor).astype(image.dtype.newbyteorder(order)).tobytes())
                out += bytes(len(out) % 2)
                offsets.append(len(out))
                sizes.append(len(held))
                out += held
        tags: dict[int, tuple[int, list[int]]] = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8 * image.dtype.itemsize] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [across]), TILE_HEIGHT: (4, [down]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [down]), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            held = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(held) > 4:
                out += bytes(len(out) % 2)
                held, place = struct.pack(order + "I", len(out)), held
                out += place
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + held.ljust(4, b"\0")
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


#: Samples across, and rows of a page at most, of an image that holds a payload.
ACROSS, DOWN = 64, 4096


def payload_image(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as the samples of a deflated grey image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ACROSS)
    return encode((rows[i : i + DOWN] for i in range(0, len(rows), DOWN)), DEFLATE, 2)


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


PAGES_DDL = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def page_rows(keys: Iterable, files: Iterable[bytes | None]) -> Iterator[tuple]:
    """key and the columns of PAGES_DDL for every page; a file that can't be read gives one row with its error."""
    for key, data in zip(keys, files, strict=True):
        try:
            if data is None:
                raise TiffError("no file")
            for p in pages(data):
                yield key, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None
        except TiffError as e:
            yield key, *[None] * 9, str(e)


def tiff_pages(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row for each page of each file: ``id_col``, then PAGES_DDL.

    Samples are in the machine's byte order, row by row. Pages before a fault are kept, the fault
    is a row with null columns and ``error``; a null or empty file, a file without pages and a page of over 2 GiB of
    samples, more than a row can hold, are such rows. Repeated rows stay; an empty table has no rows; other
    columns are not read.
    """
    kind = dict(files.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(page_rows([batch.column(0)[i].as_py()], [batch.column(1)[i].as_py()]))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [batch.schema.field(0).type, *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, *[c.split()[0] for c in PAGES_DDL.split(", ")]])

    return files.select(F.col(id_col), F.col(data_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, {PAGES_DDL}")


def feature(pixels: np.ndarray) -> str:
    """A coarse look of one grey column of samples: mean, spread, and the ranks of 16 bands' means."""
    flat = pixels.reshape(-1)
    sums = np.add.reduceat(flat.astype(np.int64), np.linspace(0, len(flat), 16, endpoint=False).astype(int))
    bins = np.bincount(flat >> 5, minlength=8)
    return ":".join([str(int(flat.sum(dtype=np.int64)) * 1000 // len(flat)), "".join("1" if s * 16 > sums.sum() else "0" for s in sums.tolist()), ",".join(map(str, bins.tolist()))])


DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text in an image, read the image back page by page, and describe it.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple of 64, a null text
    counting as empty. Equal texts have equal values; repeated rows stay; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                payload = padded(text.as_py())
                n_bytes = 0 if not text.is_valid else text.as_buffer().size
                media = payload_image(payload)
                whole, hashed, tail, n = [], hashlib.sha256(), b"", 0
                for row in page_rows([None], [media]):
                    if row[-1] is not None:
                        raise TiffError(row[-1])
                    hashed.update(row[9])
                    tail = (tail + row[9][-64:])[-64:]
                    whole.append(row[9])
                    n += 1
                back = whole[0] if n == 1 else b"".join(whole)
                out.append((key.as_py(), n_bytes, len(back), hashed.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(back, np.uint8)), n))
            if out:
                types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
                fields = [c.split() for c in DIGEST_DDL.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DIGEST_DDL)
