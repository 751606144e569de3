"""Media columns: payloads as PNG images in binary columns, with perceptual hashes.

The stored form is an 8-bit PNG: each row under the filter that leaves the smallest sum of absolute
differences, a zlib stream in IDAT chunks, each chunk with its CRC.  Reading tests every chunk's
checksum, inflates, undoes the five row filters with numpy, and hashes the image by the signs of its
low-frequency cosine coefficients.

Sub and Up are undone by running sums.  Average and Paeth need the pixels to the left and above, so images
with such rows are undone along anti-diagonals, those of all images of a slice together.

Cases: null text counts as empty and is stored as one padded row; null media give nulls and status
``null``; damaged media, of whatever kind, give a null payload and say in ``status`` what is wrong; rows that
repeat get the same values; columns that have the names of the new ones are replaced; an empty table gives
an empty table.  Payloads are never cut; their length is bounded by what a binary value can hold, and a
stream is never inflated beyond the size that its header states.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kgloom.llm.arrow_batches import with_columns

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

ROW_BYTES = 192
PAD = 32
IDAT_BYTES = 1 << 16
#: Rows whose filters are chosen together.
FILTER_ROWS = 4096
HASH_GRID = 32
HASH_SIDE = 8
READ_TYPE = "struct<payload:binary,width:int,height:int,channels:int,dct_hash:binary,status:string>"


def padded(data: bytes, row: int = ROW_BYTES) -> bytes:
    return data + bytes([PAD]) * (-len(data) % row or (0 if data else row))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, step: int, kind: int) -> np.ndarray:
    """Rows (height x bytes) under one of the five filters."""
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], up[1:], corner[1:, step:] = rows[:, :-step], rows[:-1], rows[:-1, :-step]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    if kind == 2:
        return rows - up
    if kind == 3:
        return rows - ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    return rows - paeth(left, up, corner)


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of one image."""
    return unfiltered_all([(kinds, rows)], step)[0]


def unfiltered_all(images: list[tuple[np.ndarray, np.ndarray]], step: int) -> list[np.ndarray]:
    """Undo the row filters of images (kinds and rows) that have rows of one length."""
    if any(len(kinds) and kinds.max() > 4 for kinds, _ in images):
        raise ValueError("unknown row filter")
    waves = [i for i, (kinds, _) in enumerate(images) if (kinds >= 3).any()]
    out = [np.zeros(0)] * len(images)
    for i in set(range(len(images))) - set(waves):
        out[i] = _by_runs(*images[i], step)
    for i, rows in zip(waves, _by_diagonals([images[i] for i in waves], step)):
        out[i] = rows
    return out


def _by_runs(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Rows under None, Sub and Up; runs of rows under one filter are undone together."""
    out = np.empty_like(rows)
    height, width = rows.shape
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, height]):
        if kinds[a] == 0:
            out[a:b] = rows[a:b]
        elif kinds[a] == 1:
            out[a:b] = np.cumsum(rows[a:b].reshape(b - a, -1, step), axis=1, dtype=np.uint8).reshape(b - a, width)
        else:
            above = out[a - 1] if a else np.zeros(width, np.uint8)
            out[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8) + above
    return out


def _by_diagonals(images: list[tuple[np.ndarray, np.ndarray]], step: int) -> list[np.ndarray]:
    """Rows under any filters: the pixels whose column and row number sum to the same are undone together.

    Images stand below each other on one canvas, each under a row of zeros and all behind a pixel of zeros,
    so that a pixel's neighbours are at fixed distances.
    """
    if not images:
        return []
    heights = np.array([len(kinds) for kinds, _ in images])
    width = images[0][1].shape[1]
    long = width + step
    tops = np.cumsum(heights + 1) - heights
    canvas = np.zeros((int((heights + 1).sum()), long), np.uint8)
    for top, (kinds, rows) in zip(tops, images):
        canvas[top : top + len(rows), step:] = rows
    flat = canvas.ravel()
    y = np.concatenate([np.arange(h) for h in heights])
    starts = (np.repeat(tops, heights) + y) * long + step
    by = np.argsort(y, kind="stable")
    y, starts, kinds = y[by], starts[by], np.concatenate([kinds for kinds, _ in images])[by]
    across = width // step
    lows = np.searchsorted(y, np.arange(int(heights.max()) + across) - across, side="right")
    highs = np.searchsorted(y, np.arange(int(heights.max()) + across), side="right")
    lanes = np.arange(step)
    for d, (lo, hi) in enumerate(zip(lows, highs)):
        if lo == hi:
            continue
        at = starts[lo:hi] + (d - y[lo:hi]) * step
        kind = kinds[lo:hi]
        if step > 1:
            at, kind = (at[:, None] + lanes).ravel(), np.repeat(kind, step)
        left, up, corner = flat[at - step].astype(np.int16), flat[at - long].astype(np.int16), flat[at - long - step].astype(np.int16)
        guess = np.choose(kind, (0, left, up, (left + up) >> 1, paeth(left, up, corner)))
        flat[at] += guess.astype(np.uint8)
    return [canvas[top : top + h, step:].copy() for top, h in zip(tops, heights)]


def chosen_filters(rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the filter whose bytes, read as signed, have the smallest sum of absolute values (the first of equals), and the row under it."""
    made = np.stack([filtered(rows, step, kind) for kind in range(5)])
    cost = np.minimum(made, np.uint8(0) - made).sum(axis=2, dtype=np.int64)
    kinds = cost.argmin(axis=0)
    return kinds.astype(np.uint8), made[kinds, np.arange(len(rows))]


def write_png(data: bytes, row: int = ROW_BYTES, colour: int = 0, kind: int | None = None, level: int = 6) -> bytes:
    """``data`` (a positive multiple of ``row`` bytes) as a PNG; ``kind`` holds one filter for all rows, else each row has its own."""
    step = CHANNELS[colour]
    if not data or len(data) % row or row % step:
        raise ValueError("the payload does not fill whole rows")
    rows = np.frombuffer(data, np.uint8).reshape(-1, row)
    lines = np.empty((len(rows), row + 1), np.uint8)
    if kind is not None:
        lines[:, 0], lines[:, 1:] = kind, filtered(rows, step, kind)
    else:
        for a in range(0, len(rows), FILTER_ROWS):  # with the row above, whose own filter is not taken
            kinds, best = chosen_filters(rows[max(0, a - 1) : a + FILTER_ROWS], step)
            lines[a : a + FILTER_ROWS, 0], lines[a : a + FILTER_ROWS, 1:] = kinds[min(a, 1) :], best[min(a, 1) :]
    stream = zlib.compress(lines.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", row // step, len(rows), 8, colour, 0, 0, 0))]
    parts += [_chunk(b"IDAT", stream[i : i + IDAT_BYTES]) for i in range(0, len(stream), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def parsed(media: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters and filtered rows of a PNG and its channels; raises ValueError on any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, stream, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(media):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')} differs")
        if (kind == b"IHDR") != (header is None):
            raise ValueError("the header is missing, late or repeated")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("the header has another length")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"critical chunk {kind.decode('latin-1')} is unknown")
        at += 12 + size
    if header is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, compression, filters, interlace = header
    if not 0 < width < 2**31 or not 0 < height < 2**31:
        raise ValueError("width or height is out of range")
    if compression or filters:
        raise ValueError("unknown compression or filter method")
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit images without interlacing are read")
    step = CHANNELS[colour]
    size = height * (width * step + 1)
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(stream), size + 1)
    except zlib.error as e:
        raise ValueError(f"stream: {e}") from e
    if len(raw) != size or not inflate.eof:
        raise ValueError("the stream has another length")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * step + 1)
    if lines[:, 0].max() > 4:
        raise ValueError("unknown row filter")
    return lines[:, 0], lines[:, 1:], step


def read_png(media: bytes) -> tuple[np.ndarray, int, int]:
    """Rows of samples, width and channels; raises ValueError on any damage."""
    kinds, rows, step = parsed(media)
    return unfiltered(kinds, rows, step), rows.shape[1] // step, step


def read_all(media: list[bytes | None]) -> list[tuple[np.ndarray, int] | str]:
    """Rows of samples and channels of each image, or what is wrong with it."""
    out: list[tuple[np.ndarray, int] | str] = ["null"] * len(media)
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for i, image in enumerate(media):
        if image is not None:
            try:
                kinds, rows, step = parsed(image)
                groups.setdefault((rows.shape[1], step), []).append((i, kinds, rows))
            except ValueError as e:
                out[i] = str(e)
    for (_, step), found in groups.items():
        for (i, _, _), rows in zip(found, unfiltered_all([(kinds, rows) for _, kinds, rows in found], step)):
            out[i] = (rows, step)
    return out


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(HASH_SIDE)[:, None], np.arange(HASH_GRID)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * HASH_GRID))


def _shrunk(image: np.ndarray, axis: int) -> np.ndarray:
    size = image.shape[axis]
    cuts = np.arange(HASH_GRID + 1) * size // HASH_GRID
    if size < HASH_GRID:
        return image.take(np.minimum(cuts[:-1], size - 1), axis)
    sums = np.add.reduceat(image, cuts[:-1], axis)
    width = np.diff(cuts).reshape((-1, 1) if axis == 0 else (1, -1))
    return sums / width


def dct_hash(rows: np.ndarray, step: int = 1) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 grey image exceed their median (the constant term apart)."""
    grey = rows.reshape(len(rows), -1, step).mean(axis=2) if step > 1 else rows.astype(np.float64)
    small = _shrunk(_shrunk(grey, 0), 1)
    low = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


_IMAGE = pa.struct([("payload", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("dct_hash", pa.binary()), ("status", pa.string())])


def store_media(df: DataFrame, text: str = "text", into: str = "media", row: int = ROW_BYTES) -> DataFrame:
    """``df`` with the PNG of each text's padded UTF-8 bytes in the binary column ``into``."""

    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([write_png(padded(t or b"", row), row) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())]

    return with_columns(df, text, [T.StructField(into, T.BinaryType())], work)


def read_media(df: DataFrame, media: str = "media", into: str = "image") -> DataFrame:
    """``df`` with payload, shape, hash and status of the PNGs of a binary column."""

    def shown(found: tuple[np.ndarray, int] | str) -> dict:
        if isinstance(found, str):
            return {"status": found}
        rows, step = found
        return {"payload": rows.tobytes(), "width": rows.shape[1] // step, "height": len(rows), "channels": step, "dct_hash": dct_hash(rows, step), "status": "ok"}

    kind = T.StructType.fromDDL(READ_TYPE.removeprefix("struct<").removesuffix(">").replace(":", " "))
    return with_columns(df, media, [T.StructField(into, kind)], lambda images: [pa.array([shown(x) for x in read_all(images.to_pylist())], _IMAGE)])
