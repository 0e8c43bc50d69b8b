import os
import random

import numpy as np
import pytest

from sextant.llm import tiff
from sextant.llm.tiff import DEFLATE, LZW, PACKBITS, RAW


@pytest.mark.parametrize("n", [0, 1, 64, 129, 6400, 200_000])
def test_codecs_round_trip(n):
    r = random.Random(n)
    for data in (os.urandom(n), bytes(r.choice(b"abcde  ") for _ in range(n)), b"\0" * n, bytes(r.choice(b"aaaaaaab") for _ in range(n))):
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_known_lzw_string():
    # the worked example of the format's specification
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw_encode(data) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("scheme", [RAW, LZW, DEFLATE, PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (64, 64), (32, 48)])
def test_pages_round_trip(scheme, predictor, tile):
    a = np.frombuffer(os.urandom(64 * 77), np.uint8).reshape(-1, 64)
    got = list(tiff.read_pages(tiff.write_tiff([a, a[:1], a[3:40, :17]], scheme, predictor, tile, 10)))
    assert [g.shape for g in got] == [(77, 64, 1), (1, 64, 1), (37, 17, 1)]
    assert (got[0][:, :, 0] == a).all() and (got[1][:, :, 0] == a[:1]).all() and (got[2][:, :, 0] == a[3:40, :17]).all()


def test_table_of_files(spark):
    a = np.arange(128, dtype=np.uint8).reshape(2, 64)
    rows = [(1, tiff.write_tiff([a, a])), (2, None), (3, b"junk"), (None, tiff.write_tiff([a], PACKBITS)), (5, b""), (6, tiff.write_tiff([a])[:40])]
    df = spark.createDataFrame(rows, "page long, pixels binary")
    got = sorted(((r[0], r[1], r.error is None) for r in tiff.tiff_pages(df, "page", "pixels").collect()), key=str)
    assert got == sorted([(1, 0, True), (1, 1, True), (3, -1, False), (None, 0, True), (6, -1, False)], key=str)
    assert tiff.tiff_pages(df.limit(0), "page", "pixels").count() == 0


def test_planes_apart_and_headers_that_lie(spark):
    import struct

    a = np.frombuffer(os.urandom(6 * 64), np.uint8).reshape(6, 64)
    one = tiff.write_tiff([a], RAW, rows_per_strip=2)

    def with_tag(data, tag, value):
        (at,) = struct.unpack_from("<I", data, 4)
        (n,) = struct.unpack_from("<H", data, at)
        out = bytearray(data)
        for i in range(n):
            if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag:
                struct.pack_into("<I", out, at + 10 + 12 * i, value)
        return bytes(out)

    # Three planes of two rows: the predictor's tag becomes the planar configuration.
    planar = bytearray(with_tag(with_tag(one, tiff.HEIGHT, 2), tiff.SAMPLES, 3))
    k = planar.index(struct.pack("<HHII", tiff.PREDICTOR, 3, 1, 1))
    planar[k : k + 12] = struct.pack("<HHII", tiff.PLANAR, 3, 1, 2)
    (page,) = tiff.read_pages(bytes(planar))
    assert page.shape == (2, 64, 3) and all((page[:, :, i] == a[2 * i : 2 * i + 2]).all() for i in range(3))
    lies = [with_tag(with_tag(one, tiff.WIDTH, 1 << 31), tiff.HEIGHT, 1 << 31), with_tag(one, tiff.WIDTH, 0), with_tag(one, tiff.HEIGHT, 7), with_tag(one, tiff.ROWS_PER_STRIP, 1 << 31)]
    bomb = with_tag(tiff.write_tiff([np.zeros((1, 64), np.uint8)]), tiff.HEIGHT, 1 << 31)
    rows = [(i, x, "other") for i, x in enumerate([*lies, bomb])]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id long, file binary, error string"), "id", "file").collect()
    assert sorted((r.id, r.page) for r in got) == [(i, -1) for i in range(5)] and all(r.error for r in got)


def plain_pages(data):
    """Directories of little-endian files with one byte a sample, decoded code by code and byte by byte."""
    size, pages, at = {2: 1, 3: 2, 4: 4}, [], int.from_bytes(data[4:8], "little")
    while at:
        n, tags = int.from_bytes(data[at : at + 2], "little"), {}
        for i in range(n):
            entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind, count = (int.from_bytes(entry[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8)))
            w = size[kind]
            where = entry[8:] if w * count <= 4 else data[int.from_bytes(entry[8:], "little") :]
            tags[tag] = [int.from_bytes(where[w * j : w * j + w], "little") for j in range(count)]
        at = int.from_bytes(data[at + 2 + 12 * n : at + 6 + 12 * n], "little")
        (width,), (height,), (scheme,), (predictor,) = (tags[t] for t in (256, 257, 259, 317))
        rows = [bytearray(width) for _ in range(height)]
        tiled = 324 in tags
        tall, wide = (tags[323][0], tags[322][0]) if tiled else (tags[278][0], width)
        for k, (offset, length) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
            raw, part = data[offset : offset + length], bytearray()
            if scheme == 8:
                import zlib

                part += zlib.decompress(raw)
            elif scheme == 32773:
                i = 0
                while i < len(raw):
                    head = raw[i]
                    part += raw[i + 1 : i + 2 + head] if head < 128 else raw[i + 1 : i + 2] * (257 - head)
                    i += head + 2 if head < 128 else 2
            else:
                bits, p, table, width_of, before = "".join(f"{b:08b}" for b in raw), 0, {}, 9, b""
                while True:
                    code = int(bits[p : p + width_of], 2)
                    p += width_of
                    if code == 257:
                        break
                    if code == 256:
                        table, width_of, before = {i: bytes([i]) for i in range(256)}, 9, b""
                        continue
                    entry = table.get(code, before + before[:1])
                    if before:
                        table[258 + len(table) - 256] = before + entry[:1]
                    width_of = max(width_of, min(12, (258 + len(table) - 256 + 1).bit_length()))
                    part += entry
                    before = entry
            across = -(-width // wide)
            for i in range(len(part) // wide):
                row, top, left = part[i * wide : (i + 1) * wide], k // across * tall + i, k % across * wide
                if predictor == 2:
                    for j in range(1, wide):
                        row[j] = (row[j] + row[j - 1]) % 256
                if top < height:
                    rows[top][left : left + wide] = row[: width - left]
        pages.append((width, height, b"".join(map(bytes, rows))))
    return pages


def test_query_reads_back_what_it_stored(spark, tmp_path):
    import hashlib
    import zlib

    texts = ["", None, "a", "x" * 64, "é\u0000 字" * 40_001, "x" * 64, *(f"text {i} " * (i % 90) for i in range(60))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in tiff.op8_tiff(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        media = tiff.store_bytes(padded)
        pages = plain_pages(media)
        assert b"".join(p for _, _, p in pages) == padded and (len(pages) > 1) == (len(padded) > 64 * tiff.PAGE_ROWS)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        values = np.frombuffer(padded, np.uint8)
        share = np.bincount(values) / len(values)
        share = share[share > 0]
        shapes, mean, std, entropy = r.feature.split(";")
        assert shapes == "+".join(f"{w}x{h}" for w, h, _ in pages)
        want = (values.mean(), values.std(), -(share * np.log2(share)).sum())
        assert all(abs(float(x.split("=")[1]) - y) < 2e-6 for x, y in zip((mean, std, entropy), want))


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "same", 5), (1, "same", 5), (None, "same", 1), (2, None, 2), (3, "", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, media long").write.parquet(f"{tmp_path}/documents.parquet")
    got = tiff.op8_tiff(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes) for r in got) == [(False, 0, 4), (True, 1, 4), (True, 1, 4), (True, 2, 0), (True, 3, 0)]
    assert len({r[2:] for r in got if r.n_bytes}) == 1 and len({r[2:] for r in got if not r.n_bytes}) == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tiff.op8_tiff(spark, f"{tmp_path}/none").count() == 0
