"""TIFF media columns: store bytes as images, walk image directories, decode pages.

The reader takes both byte orders, strips and tiles, no compression, PackBits, LZW
and deflate, the horizontal predictor, 8- or 16-bit samples, and samples together or
in planes of their own; it gives one row per page.  Each file is decoded inside the
row's own task.

Defined results: null or empty media give no pages; a file that cannot be decoded
gives one row with its ``error`` and null pixels, and never fails the job; a
directory chain that loops ends where it would repeat; strips that end early are
filled with zeros; an image that its data could never fill counts as bad before memory
is taken for it; extra columns pass through, and columns of the output names are
replaced; repeated rows are decoded alike; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernels import mapped

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
#: Fixed values of the format: tag numbers.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
#: Most bytes that a stored byte can stand for, by compression.
EXPANSION = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, 32946: 1032, LZW: 4096}
#: Bytes and struct letters of the field types that matter here.
FIELD_TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
#: Row width, rows of a page, and rows of a strip of stored texts.
ROW, PAGE_ROWS, STRIP_ROWS, TILE = 64, 1024, 64, 32


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def pack_bits(rows: np.ndarray) -> bytes:
    """PackBits of each row; rows without a run of three bytes are one literal."""
    width = rows.shape[1]
    if width <= 128:
        runs = (rows[:, 2:] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, :-2])
        plain = ~runs.any(axis=1)
        if plain.all():
            return np.concatenate((np.full((len(rows), 1), width - 1, dtype=np.uint8), rows), axis=1).tobytes()
    out = bytearray()
    for row in rows:
        data = row.tobytes()
        edges = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(data)]
        literal = 0
        for a, b in zip(edges, edges[1:]):
            if b - a < 3:
                continue
            for x in range(literal, a, 128):
                part = data[x : min(a, x + 128)]
                out.append(len(part) - 1)
                out += part
            for x in range(a, b, 128):
                n = min(128, b - x)
                out += bytes((257 - n if n > 1 else 0, data[a]))
            literal = b
        for x in range(literal, len(data), 128):
            part = data[x : x + 128]
            out.append(len(part) - 1)
            out += part
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out = bytearray()
    i, end = 0, len(data)
    while i < end and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_pack(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, widened one code early, high bits first."""
    codes, widths = [256], [9]
    single = {bytes((b,)): b for b in range(256)}
    table = dict(single)
    free, width = 258, 9
    have, code = b"", 0
    for i in range(len(data)):
        more = have + data[i : i + 1]
        found = table.get(more)
        if found is not None:
            have, code = more, found
            continue
        codes.append(code)
        widths.append(width)
        table[more] = free
        free += 1
        have = data[i : i + 1]
        code = data[i]
        if free == 4095:
            codes.append(256)
            widths.append(width)
            table = dict(single)
            free, width = 258, 9
        elif free == 1 << width:
            width += 1
    if have:
        codes.append(code)
        widths.append(width)
        free += 1
        if free == 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    value, size = np.array(codes, dtype=np.uint16), np.array(widths)
    bits = (value[:, None] >> np.arange(11, -1, -1, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - size[:, None]].astype(np.uint8)).tobytes()


def lzw_unpack(data: bytes, size: int) -> bytes:
    first = [bytes((b,)) for b in range(256)] + [b"", b""]
    table, out, made = list(first), [], 0
    width, acc, have, at, end = 9, 0, 0, 0, len(data)
    last = None
    while made < size:
        while have < width:
            if at >= end:
                return b"".join(out)[:size]
            acc = (acc << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big")) & 0xFFFFFFFFFFFF
            at += 4
            have += 32
        have -= width
        code = acc >> have & ((1 << width) - 1)
        acc &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) == (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        made += len(entry)
        last = entry
    return b"".join(out)[:size]


def _pack(rows: np.ndarray, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(rows.tobytes(), 1)
    if compression == LZW:
        return lzw_pack(rows.tobytes())
    return pack_bits(rows) if compression == PACKBITS else rows.tobytes()


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_unpack(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == NONE:
        return data[:size]
    raise ValueError(f"compression {compression} is not supported")


def write(payload: bytes, compression: int = DEFLATE, predictor: bool = False, tiled: bool = False, page_rows: int = PAGE_ROWS) -> bytes:
    """A little-endian greyscale TIFF of ``payload``, a positive multiple of 64 bytes, in rows of 64 and pages of ``page_rows``."""
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        if tiled:
            full = np.zeros((-(-len(page) // TILE) * TILE, ROW), dtype=np.uint8)
            full[: len(page)] = page
            parts = [full[y : y + TILE, x : x + TILE] for y in range(0, len(full), TILE) for x in range(0, ROW, TILE)]
        else:
            parts = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        offsets, counts = [], []
        for part in parts:
            if predictor:
                part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
            data = _pack(np.ascontiguousarray(part), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        n = len(parts)
        at = [0, 0]
        if n > 1:
            at = [len(out), len(out) + 4 * n]
            out += struct.pack(f"<{2 * n}I", *offsets, *counts)
        else:
            at = [offsets[0], counts[0]]
        tags = [(WIDTH, 4, 1, ROW), (LENGTH, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1)]
        tags += [] if tiled else [(STRIP_OFFSETS, 4, n, at[0])]
        tags += [(SAMPLES, 3, 1, 1)]
        tags += [] if tiled else [(ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_COUNTS, 4, n, at[1])]
        tags += [(PREDICTOR, 3, 1, 2 if predictor else 1)]
        tags += [(TILE_WIDTH, 4, 1, TILE), (TILE_LENGTH, 4, 1, TILE), (TILE_OFFSETS, 4, n, at[0]), (TILE_COUNTS, 4, n, at[1])] if tiled else []
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, kind, number, value in tags:
            out += struct.pack("<HHII", tag, kind, number, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read(data: bytes) -> Iterator[Page]:
    """Pages of a TIFF in the order of its directories; raises ValueError, struct.error or zlib.error on bad files."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, number = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size, letter = FIELD_TYPES.get(kind, (0, ""))
            if size:
                where = at + 10 + 12 * i
                if size * number > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(f"{order}{number}{letter}", data, where)
        yield _page(data, tags, order)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16) or not width or not height:
        raise ValueError(f"{bits}-bit image of {width} x {height} is not supported")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    wide, high = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags.get(TILE_OFFSETS, ()), tags.get(TILE_COUNTS, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    stored = sum(min(b, len(data)) for b in counts) * EXPANSION.get(compression, 1)
    if width * height * samples * kind.itemsize > stored or wide * high * samples * kind.itemsize > stored:
        raise ValueError(f"{width} x {height} samples do not fit {len(data)} bytes")
    across, down = -(-width // wide), -(-height // high)
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    image = np.zeros((down * high, across * wide, samples), dtype=kind.newbyteorder("="))
    for i, (a, b) in enumerate(zip(offsets, counts)):
        plane, i = divmod(i, across * down)
        if plane >= planes:
            break
        y, x = i // across * high, i % across * wide
        rows = high if tiled else min(high, height - y)
        size = rows * wide * each * kind.itemsize
        raw = _unpack(data[a : a + b], compression, size)
        part = np.frombuffer(raw.ljust(size, b"\0"), dtype=kind).astype(image.dtype).reshape(rows, wide, each)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=image.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        image[y : y + rows, x : x + wide, plane * each : (plane + 1) * each] = part
    return Page(width, height, samples, bits, compression, predictor, tiled, image[:height, :width].tobytes())


#: Stored forms by the payload's checksum: (compression, predictor, tiled).
LAYOUTS = ((DEFLATE, True, True), (PACKBITS, False, False), (LZW, False, False), (DEFLATE, True, False))


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "replace")
    return data + b"\0" * (-len(data) % ROW or (0 if data else ROW))


def store_texts(docs: DataFrame, text_col: str, media_col: str = "media") -> DataFrame:
    """Replace the text by ``media_col``, a TIFF of its payload, and add ``n_bytes``; the layout depends on the text only."""
    kept = [c for c in docs.columns if c not in (text_col, media_col, "n_bytes")]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                media, sizes = [], []
                for x in part.column(names.index(text_col)):
                    text = x.as_py()
                    payload = payload_of(text)
                    sizes.append(len((text or "").encode("utf-8", "replace")))
                    media.append(write(payload, *LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]))
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in kept), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*kept, "n_bytes", media_col])

    return mapped(docs, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())]))


PAGE_FIELDS = [T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.IntegerType()), T.StructField("predictor", T.IntegerType()), T.StructField("tiled", T.BooleanType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())]


def read_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the other columns, the page's number and facts, its pixels, and an error if the file is bad from there on."""
    made = {f.name for f in PAGE_FIELDS}
    kept = [c for c in media.columns if c != media_col and c not in made]
    names = media.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                who, rows = [], []
                for i, x in enumerate(part.column(names.index(media_col))):
                    data = x.as_py()
                    if not data:
                        continue
                    n = 0
                    try:
                        for n, p in enumerate(read(data), 1):
                            who.append(i)
                            rows.append((n - 1, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None))
                    except (ValueError, IndexError, ZeroDivisionError, MemoryError, struct.error, zlib.error) as e:
                        who.append(i)
                        rows.append((n, None, None, None, None, None, None, None, None, str(e)))
                if rows:
                    take = pa.array(who, pa.int64())
                    kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)).take(take) for c in kept), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*kept, *(f.name for f in PAGE_FIELDS)])

    return mapped(media, run, T.StructType([*(media.schema[c] for c in kept), *PAGE_FIELDS]))


DIGEST_FIELDS = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]


def feature_of(pixels: bytes, pages: int) -> str:
    """Pages, mean, deviation and entropy of the samples, and the mean step between neighbours."""
    counts = np.bincount(np.frombuffer(pixels, dtype=np.uint8), minlength=256)
    n = max(len(pixels), 1)
    share, level = counts[counts > 0] / n, np.arange(256)
    mean = float((counts * level).sum() / n)
    spread = max(float((counts * level * level).sum() / n) - mean * mean, 0.0) ** 0.5
    steps = np.abs(np.diff(np.frombuffer(pixels, dtype=np.uint8).astype(np.int16)))
    return f"pages={pages};mean={mean:.4f};sd={spread:.4f};entropy={-(share * np.log2(share)).sum():.4f};step={steps.mean() if len(steps) else 0.0:.4f}"


def digests(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Replace the media by digests of all its pages, as :func:`read_pages` gives them; files without pages are left out.

    A file that does not decode is an error here: its digests would be those of a part.
    Where files are not one's own, :func:`read_pages` gives the error as a row instead.
    A file's pages come one after the other, from page 0 on, in the task that decoded
    them, so they need no shuffle to meet.
    """
    kept = [c for c in media.columns if c != media_col and c not in {f.name for f in (*DIGEST_FIELDS, *PAGE_FIELDS)}]
    stored = {"media_bytes": F.octet_length(F.col(f"`{media_col}`")).cast("long"), "media_sha256": F.sha2(F.col(f"`{media_col}`"), 256)}
    pages = read_pages(media.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{media_col}`"), *[v.alias(k) for k, v in stored.items()]), media_col)
    names = [*kept, "media_bytes", "media_sha256", "page", "pixels", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = None, []
        done, rows = [], []

        def close() -> None:
            payload = b"".join(parts)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), first.column("media_bytes")[0].as_py(), first.column("media_sha256")[0].as_py(), feature_of(payload, len(parts))))
            done.append(first.select(kept))

        def pack() -> pa.RecordBatch:
            table = pa.concat_tables([pa.Table.from_batches([x]) for x in done]).combine_chunks().to_batches()
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([*(table[0].columns if kept else ()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[*kept, *(f.name for f in DIGEST_FIELDS)])

        for batch in batches:
            starts, pixels, errors = batch.column("page").to_pylist(), batch.column("pixels"), batch.column("error")
            for i, n in enumerate(starts):
                if n == 0:
                    if first is not None:
                        close()
                    first, parts = batch.slice(i, 1), []
                    if len(rows) >= 1000:
                        yield pack()
                        done, rows = [], []
                if errors[i].is_valid:
                    raise ValueError(f"stored media do not decode: {errors[i].as_py()}")
                parts.append(pixels[i].as_py())
        if first is not None:
            close()
        if rows:
            yield pack()

    fields = {f.name: f for f in pages.schema.fields}
    return mapped(pages.select(*[F.col(f"`{c}`") for c in names]), run, T.StructType([*(fields[c] for c in kept), *DIGEST_FIELDS]))
