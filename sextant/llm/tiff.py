"""Media columns: TIFF files in a binary column, read to one row per page, and a writer for lossless 8-bit storage.

The reader walks the chain of image file directories (either byte order), decodes strips or tiles stored raw, by PackBits,
LZW or deflate, in one plane or a plane for each sample, undoes the horizontal predictor and returns the samples of every page.

Cases: a null or empty file gives no page; a file that is not a TIFF, is truncated or uses a feature outside this list gives
one row with page -1 and the reason in `error`, and none of its pages; so does a directory whose sizes don't fit its strips or
tiles, before memory is taken by what it claims; a chain of directories that loops ends at the first one seen twice. Null and
repeated ids are carried along; other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table, utf8

# Fixed values of the TIFF 6.0 format: tags, field types (struct codes), compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
RAW, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += head + 2
        else:
            if head > 128:
                out.append(data[i + 1 : i + 2] * (257 - head))
                i += 1
            i += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    lengths = np.diff(np.append(starts, len(a)))
    out, literal = [], 0

    def literals(lo: int, hi: int) -> None:
        for at in range(lo, hi, 128):
            part = data[at : min(at + 128, hi)]
            out.append(bytes((len(part) - 1,)) + part)

    for start, length in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist()):
        literals(literal, start)
        byte, left = data[start : start + 1], length
        while left >= 2:
            n = min(left, 128)
            out.append(bytes((257 - n,)) + byte)
            left -= n
        literal = start + length - left
    literals(literal, len(data))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; code widths grow one code early, as the format asks for."""
    codes = {bytes((i,)): i for i in range(256)}
    bits, n_bits, width, following, prefix, out = CLEAR, 9, 9, 258, b"", bytearray()
    for i in range(len(data)):
        byte = data[i : i + 1]
        longer = prefix + byte
        if longer in codes:
            prefix = longer
            continue
        bits, n_bits = bits << width | codes[prefix], n_bits + width
        codes[longer] = following
        following += 1
        if following == 4094:
            bits, n_bits = bits << width | CLEAR, n_bits + width
            codes, width, following = {bytes((i,)): i for i in range(256)}, 9, 258
        elif following >= 1 << width and width < 12:
            width += 1
        prefix = byte
        if n_bits >= 4096:
            out += (bits >> n_bits % 8).to_bytes(n_bits // 8, "big")
            n_bits %= 8
            bits &= (1 << n_bits) - 1
    if prefix:
        bits, n_bits = bits << width | codes[prefix], n_bits + width
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    bits, n_bits = bits << width | END, n_bits + width
    pad = -n_bits % 8
    return bytes(out) + (bits << pad).to_bytes((n_bits + pad) // 8, "big")


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """most: bytes after which it is enough."""
    left = len(data) * 4096 if most is None else most
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    entries, width, last, out = list(base), 9, None, []
    buffer, n_bits, at, n = 0, 0, 0, len(data)
    while True:
        while n_bits < width:
            if at >= n:
                return b"".join(out)  # no end code: what there is
            chunk = data[at : at + 6]
            buffer = (buffer & (1 << n_bits) - 1) << 8 * len(chunk) | int.from_bytes(chunk, "big")
            n_bits += 8 * len(chunk)
            at += len(chunk)
        n_bits -= width
        code = buffer >> n_bits & (1 << width) - 1
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            entries, width, last = list(base), 9, None
            continue
        if last is None:
            entry = entries[code]
        else:
            if code < len(entries):
                entry = entries[code]
            elif code == len(entries):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            entries.append(last + entry[:1])
            if len(entries) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        last = entry
        left -= len(entry)
        if left <= 0 and most is not None:
            return b"".join(out)


def inflate(data: bytes, scheme: int, size: int) -> bytes:
    """A strip or tile that unpacks to size bytes; no more than those (and a code's worth) are unpacked."""
    if scheme == RAW:
        return data
    if scheme == PACKBITS:
        return packbits_decode(data)  # 64 times its length at most
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, max(1, size))
    raise ValueError(f"compression {scheme}")


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = FIELD.get(kind)
        if code is None:
            continue
        size = struct.calcsize(order + code) * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _page(data: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, scheme, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, RAW), one(PREDICTOR, 1)
    bits = one(BITS, 8)
    if bits not in (8, 16) or predictor not in (1, 2):
        raise ValueError(f"{bits} bits, predictor {predictor}")
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(np.uint16).newbyteorder(order)
    tiled, planes = TILE_OFFSETS in tags, samples if one(PLANAR, 1) == 2 else 1
    across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height) or height, height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if min(width, height, samples, across, down) < 1:
        raise ValueError(f"{width} x {height} pixels of {samples} samples in parts of {across} x {down}")
    per_row, per_column = -(-width // across), -(-height // down)
    if per_row * per_column * planes != len(offsets):
        raise ValueError(f"{len(offsets)} strips or tiles for {width} x {height} pixels")
    deep, parts = samples // planes, []
    for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        rows = down if tiled else min(down, height - k % per_column * down)
        raw = inflate(data[offset : offset + count], scheme, rows * across * deep * kind.itemsize)
        part = np.frombuffer(raw, kind, rows * across * deep).reshape(rows, across, deep)
        parts.append(np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else part)
    page = np.zeros((height, width, samples), kind.newbyteorder("="))  # the parts, which are there, cover it
    for k, part in enumerate(parts):
        plane, at = divmod(k, per_row * per_column)
        top, left = at // per_row * down, at % per_row * across
        h, w = min(len(part), height - top), min(across, width - left)
        page[top : top + h, left : left + w, plane * deep : (plane + 1) * deep] = part[:h, :w]
    return page


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    """Samples (rows, columns, samples per pixel) of each page in the order of the directories."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        tags, following = _directory(data, order, at)
        yield _page(data, tags, order)
        at = following


def write_tiff(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 1024) -> bytes:
    """8-bit grey pages (rows, columns) as one little-endian file, in strips or in tiles (rows, columns)."""
    pack = {RAW: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[scheme]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        height, width = page.shape
        blocks = []
        if tile:
            for top in range(0, height, tile[0]):
                for left in range(0, width, tile[1]):
                    block = np.zeros(tile, np.uint8)
                    cut = page[top : top + tile[0], left : left + tile[1]]
                    block[: cut.shape[0], : cut.shape[1]] = cut
                    blocks.append(block)
        else:
            blocks = [page[top : top + rows_per_strip] for top in range(0, height, rows_per_strip)]
        places = []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            stored = pack(np.ascontiguousarray(block, np.uint8).tobytes())
            places.append((len(out), len(stored)))
            out += stored + b"\0" * (len(stored) % 2)
        lists = []
        for values in zip(*places):
            lists.append(len(out))
            out += struct.pack(f"<{len(values)}I", *values)
        n = len(places)
        where = [p[0] if n == 1 else x for p, x in zip(zip(*places), lists)]
        tags = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, scheme), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        tags += [(TILE_WIDTH, 4, 1, tile[1]), (TILE_HEIGHT, 4, 1, tile[0]), (TILE_OFFSETS, 4, n, where[0]), (TILE_COUNTS, 4, n, where[1])] if tile else [(STRIP_OFFSETS, 4, n, where[0]), (ROWS_PER_STRIP, 4, 1, rows_per_strip), (STRIP_COUNTS, 4, n, where[1])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *x) for x in sorted(tags))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)



def tiff_pages(df: DataFrame, id_col: str, file_col: str) -> DataFrame:
    """One row per page: the id, page (from 0), its shape, its samples row by row, and error (null if read)."""
    named = df.select(F.col(id_col).alias("id"), F.col(file_col).alias("file"))
    kind = named.schema["id"].dataType.simpleString()
    out = map_rows(named, _pages_of_batches, f"id {kind}, page int, width int, height int, samples int, pixels binary, error string")
    return out.withColumnRenamed("id", id_col)


def _pages_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo in range(0, len(ids), 64):  # so many files' pages at a time
            rows, take = [], []
            for i, data in enumerate(batch.column(1).slice(lo, 64).to_pylist(), lo):
                if not data:
                    continue
                try:
                    found = [(k, p.shape[1], p.shape[0], p.shape[2], p.tobytes(), None) for k, p in enumerate(read_pages(data))]
                except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    found = [(-1, None, None, None, None, f"{type(e).__name__}: {e}")]
                rows += found
                take += [i] * len(found)
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", "page", "width", "height", "samples", "pixels", "error"])


#: Bytes in a row of a stored page, and rows of a page at most: longer payloads take several pages.
LINE, PAGE_ROWS = 64, 2048


def store_bytes(payload: bytes) -> bytes:
    """A payload of whole lines of 64 bytes as grey pages. Its CRC picks the scheme, so equal payloads are stored alike."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    pages = [rows[top : top + PAGE_ROWS] for top in range(0, len(rows), PAGE_ROWS)]
    pick = zlib.crc32(payload) % 3
    if pick == 0:
        return write_tiff(pages, LZW, rows_per_strip=128)
    return write_tiff(pages, PACKBITS, tile=(64, 64)) if pick == 1 else write_tiff(pages, DEFLATE, predictor=2)


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            raw = [utf8(x) for x in part.column(1).to_pylist()]
            files = [store_bytes(x + b"\0" * (-len(x) % LINE if x else LINE)) for x in raw]
            told = [pa.array([len(x) for x in raw], pa.int64()), pa.array(map(len, files), pa.int64()), pa.array(map(_sha, files), pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *told, pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "media"])


class _Payload:
    """Digests of a payload whose pages come one by one."""

    def __init__(self, about: dict):
        self.about, self.sha, self.counts, self.shapes, self.size, self.tail = about, hashlib.sha256(), np.zeros(256, np.int64), [], 0, b""

    def add(self, width: int, height: int, pixels: bytes) -> None:
        self.sha.update(pixels)
        self.counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        self.shapes.append(f"{width}x{height}")
        self.size, self.tail = self.size + len(pixels), (self.tail + pixels)[-LINE:]

    def row(self) -> dict:
        share, value = self.counts / self.size, np.arange(256)
        mean = (share * value).sum()
        spread = np.sqrt((share * (value - mean) ** 2).sum())
        seen = share[share > 0]
        feature = f"{'+'.join(self.shapes)};mean={mean:.6f};std={spread:.6f};entropy={-(seen * np.log2(seen)).sum() + 0.0:.6f}"
        return self.about | {"payload_bytes": self.size, "payload_sha256": self.sha.hexdigest(), "tail_crc32": zlib.crc32(self.tail), "feature": feature}


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows as tiff_pages gives them, where the pages of a file stand together and begin with page 0: a row for each file."""
    last: _Payload | None = None
    for batch in batches:
        rows = []
        for about, page, width, height, pixels, error in zip(*(batch.column(name).to_pylist() for name in ("about", "page", "width", "height", "pixels", "error"))):
            if error is not None:
                raise ValueError(f"document {about['doc_id']}: {error}")  # what was stored can always be read
            if page == 0:
                rows += [last.row()] if last else []
                last = _Payload(about)
            last.add(width, height, pixels)
        yield pa.RecordBatch.from_pylist(rows, DIGESTS)
    if last:
        yield pa.RecordBatch.from_pylist([last.row()], DIGESTS)


def op8_tiff(spark, sf_dir):
    """Every document's text through a stored TIFF file and its pages back, with digests of what was read."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    media = map_rows(docs, _stored, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, media binary")
    pages = tiff_pages(media.select(F.struct("doc_id", "n_bytes", "media_bytes", "media_sha256").alias("about"), "media"), "about", "media")
    return map_rows(pages, _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
