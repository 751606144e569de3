"""Round trips of media and archives."""

import base64
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard

from kgloom.llm import media_png, queries, warc_bundles

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
@pytest.mark.parametrize("kind", range(5))
def test_png_filters(colour, kind):
    data = RNG.integers(0, 256, 24 * 7, dtype=np.uint8).tobytes()
    image = media_png.write_png(data, 24, colour, kind)
    rows, width, step = media_png.read_png(image)
    assert rows.tobytes() == data and (width, step) == (24 // step, media_png.CHANNELS[colour])


def test_png_mixed_filters_and_damage():
    rows = RNG.integers(0, 256, (40, 24), dtype=np.uint8)
    kinds = RNG.integers(0, 5, 40)
    lines = np.array([media_png.filtered(rows, 1, k)[y] for y, k in enumerate(kinds)])
    assert (media_png.unfiltered(kinds.astype(np.uint8), lines, 1) == rows).all()
    image = media_png.write_png(bytes(192))
    for broken in (b"", image[:40], image[:-20], image[:45] + bytes([image[45] ^ 1]) + image[46:], b"x" + image):
        with pytest.raises(ValueError):
            media_png.read_png(broken)


def slow_unfiltered(kinds, rows, step):
    """Pixel by pixel, as the format's specification has it."""
    out = [[0] * rows.shape[1] for _ in rows]
    for y, (kind, row) in enumerate(zip(kinds, rows)):
        for x in range(len(row)):
            a = out[y][x - step] if x >= step else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - step] if y and x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y][x] = (int(row[x]) + (0, a, b, (a + b) // 2, near)[kind]) % 256
    return np.array(out, np.uint8)


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_png_diagonals_against_pixels(step):
    images = [(RNG.integers(0, 5, h).astype(np.uint8), RNG.integers(0, 256, (h, 12 * step), dtype=np.uint8)) for h in (1, 2, 9, 40, 3)]
    images.append((np.full(6, 2, np.uint8), images[3][1][:6]))
    for (kinds, rows), got in zip(images, media_png.unfiltered_all(images, step)):
        assert (got == slow_unfiltered(kinds, rows, step)).all()


def test_png_rows_have_filters_of_their_own(monkeypatch):
    ramp = np.add.outer(np.arange(60) * 3, np.arange(192)).astype(np.uint8)
    steady = np.repeat(RNG.integers(0, 256, (1, 192), dtype=np.uint8), 30, axis=0)
    data = b"".join(x.tobytes() for x in (ramp, steady, RNG.integers(0, 256, (30, 192), dtype=np.uint8), np.zeros((3, 192), np.uint8))) + b"some plain text, as most payloads are. " * 96
    data = media_png.padded(data)
    kinds, rows, step = media_png.parsed(media_png.write_png(data))
    assert {1, 2, 3} <= set(kinds.tolist()) and media_png.unfiltered(kinds, rows, step).tobytes() == data
    monkeypatch.setattr(media_png, "FILTER_ROWS", 7)
    parts = media_png.parsed(media_png.write_png(data))
    assert (parts[0] == kinds).all() and (parts[1] == rows).all()


def header(width=192, height=1, depth=8, colour=0, compression=0, filters=0, interlace=0):
    return struct.pack(">IIBBBBB", width, height, depth, colour, compression, filters, interlace)


DAMAGED = {
    "the header has another length": [(b"IHDR", header()[:12])],
    "width or height is out of range": [(b"IHDR", header(height=0))],
    "unknown compression or filter method": [(b"IHDR", header(compression=9, filters=9))],
    "only 8-bit images without interlacing are read": [(b"IHDR", header(interlace=1))],
    "the header is missing, late or repeated": [(b"IDAT", b""), (b"IHDR", header())],
    "the stream has another length": [(b"IHDR", header()), (b"IDAT", zlib.compress(bytes(500_000)))],
    "unknown row filter": [(b"IHDR", header()), (b"IDAT", zlib.compress(b"\x07" + bytes(192)))],
    "critical chunk ABCD is unknown": [(b"IHDR", header()), (b"ABCD", b"")],
    "header or end is missing": [],
}


def test_damaged_media_are_reported(spark):
    images = [media_png.SIGNATURE + b"".join(media_png._chunk(k, b) for k, b in [*chunks, (b"IEND", b"")][: None if chunks else 0]) for chunks in DAMAGED.values()]
    zero = media_png.SIGNATURE + media_png._chunk(b"IHDR", header(width=0)) + media_png._chunk(b"IEND", b"")
    short = media_png.SIGNATURE + media_png._chunk(b"IHDR", header()) + media_png._chunk(b"IDAT", zlib.compress(bytes(193))[:-3]) + media_png._chunk(b"IEND", b"")
    rows = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*images, zero, short, media_png.write_png(bytes(192))])], "i int, media binary, image string")
    got = [r["image"] for r in media_png.read_media(rows).orderBy("i").collect()]
    assert [r["status"] for r in got] == [*DAMAGED, "width or height is out of range", "the stream has another length", "ok"]
    assert all(r["payload"] is None for r in got[:-1]) and got[-1]["payload"] == bytes(192)


def test_dct_hash_against_sums():
    rows = RNG.integers(0, 256, (64, 64), dtype=np.uint8)
    small = rows.astype(float).reshape(32, 2, 32, 2).mean(axis=(1, 3))
    n = np.arange(32)
    low = np.array([[(small * np.cos(np.pi * (2 * n[:, None] + 1) * u / 64) * np.cos(np.pi * (2 * n[None] + 1) * v / 64)).sum() for v in range(8)] for u in range(8)]).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    assert media_png.dct_hash(rows) == np.packbits(bits).tobytes()


def test_media_columns(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op2_media(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        data = (d["text"] or "").encode()
        full = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        image = media_png.write_png(full)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media_png.dct_hash(np.frombuffer(full, np.uint8).reshape(-1, 192)).hex())
    edge = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 300000, 1), (3, "x", 1)], "doc_id long, text string, media int")
    got = media_png.read_media(media_png.store_media(edge)).collect()
    assert [len(r["image"]["payload"]) for r in sorted(got, key=lambda r: (r["doc_id"], len(r["text"] or "")))] == [192, 192, 192, 300096]
    bad = spark.createDataFrame([(1, None), (2, b"junk")], "i int, media binary")
    assert {r["image"]["status"] for r in media_png.read_media(bad).collect()} == {"null", "not a PNG"}
    assert media_png.read_media(media_png.store_media(edge.limit(0))).count() == 0


def test_warc_round_trip(spark, sf):
    rng = random.Random(1)
    extra = [(10_000 + i, rng.choice([None, "http://a/\r\nx", "u"]), rng.choice(["", None, "same", "é" * 5, "big" * 200_000])) for i in range(30)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame([*extra, (None, "u", "same"), (None, "u", "lone"), (10_000, extra[0][1], extra[0][2])], "page_id long, url string, html string"))
    bundles = warc_bundles.write_bundles(pages)
    got = warc_bundles.read_bundles(bundles).collect()
    want = pages.collect()
    assert len(got) == len(want)
    first = {}
    for p in want:
        body = (p["html"] or "").encode()
        if p["page_id"] is not None:
            first[body] = min(first.get(body, p["page_id"]), p["page_id"])
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for p in want:
        body = (p["html"] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        kind = "response" if first.get(body, p["page_id"]) == p["page_id"] else "revisit"
        found = [r for r in by[p["page_id"]] if r["payload_digest"] == digest]
        assert found and all((r["record_type"], r["payload_bytes"], r["refers_to"]) == (kind, len(body), first[body] if kind == "revisit" else None) for r in found)
        assert all(bytes(r["payload"]) == body for r in found if kind == "response")
    archives = {r["bundle"]: bytes(r["archive"]) for r in bundles.collect()}
    places = warc_bundles.index_of(bundles).collect()
    assert len(places) == len(want)
    for r in places[::7]:
        assert warc_bundles.fetch(archives[r["bundle"]], r["frame"], r["offset"])["record_id"] == r["record_id"]
    asked = spark.createDataFrame([(r["page_id"],) for r in want[::9]] + [(-5,), (None,)], "page_id long")
    ids = [r["page_id"] for r in asked.collect()]
    shown = lambda rows: sorted(str((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"], bytes(r["payload"] or b""))) for r in rows)
    assert shown(warc_bundles.lookup(bundles, asked).collect()) == shown(r for r in got if r["page_id"] in ids)
    clash = pages.withColumn("bundle", warc_bundles.F.lit("x")).withColumn("payload", warc_bundles.F.lit(1)).withColumn("refers_to", warc_bundles.F.lit(1))
    assert sorted(map(str, warc_bundles.read_bundles(warc_bundles.write_bundles(clash)).select(*warc_bundles.record_rows(bundles)).collect())) == sorted(str(r) for r in warc_bundles.read_bundles(bundles).select(*warc_bundles.record_rows(bundles)).collect())
    for archive in archives.values():
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(archive), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n")
    assert warc_bundles.read_bundles(warc_bundles.write_bundles(pages.limit(0))).count() == 0


def test_warc_damage():
    record = warc_bundles.write_record(1, "u", b"body", False, None)
    with pytest.raises(ValueError):
        warc_bundles.read_record(record.replace(b"body", b"boby"))
    with pytest.raises(ValueError):
        warc_bundles.frames_of(b"0" * 40)
