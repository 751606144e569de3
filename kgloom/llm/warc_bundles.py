"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames with a seek table in
a skippable frame behind them, so any frame can be decompressed alone.  An index maps each record's
identifier to its bundle, frame and offset within the decompressed frame.  Bundles are values of a
binary column in a table of the shared folder, which every file system that Spark reads can hold.

Of records with equal payloads that with the smallest page_id is a response, the others are revisits
that carry its identifier, digest and HTTP head but not the payload.  Payloads under ``min_bytes`` are
always responses.

Cases: null html is an empty payload; a null url has no target URI of its own; rows that repeat the
smallest page_id are responses each; a null page_id comes last in the order, so such rows are responses
only where no row with that payload has an id; line breaks in a url are kept as %0D and %0A; a url that is
the record's own identifier reads back null, as records without url carry that; very long payloads are a frame
of their own, of up to 4 GB, which is what a seek table can state, and a longer one is an error; an empty table
gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.storage import written

#: Fixed values of the seekable format and of the record format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 4 << 20, 3
BUNDLE_TYPE = "bundle string, archive binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORD_TYPE = "bundle string, record_id string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
_BATCH = 64


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def page_of(identifier: str | None) -> int | None:
    tail = (identifier or "none").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def _clean(value: str) -> str:
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in value)


def write_record(page_id: int | None, url: str | None, payload: bytes, is_revisit: bool, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", record_id(page_id) if url is None else _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Fields of the record at an offset, and where the next begins; a response's digest is tested."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record begins here")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    is_revisit = fields["WARC-Type"] == "revisit"
    if not is_revisit and base32_sha1(payload) != digest:
        raise ValueError("the payload's digest differs")
    identifier = fields["WARC-Record-ID"].strip("<>")
    uri = fields["WARC-Target-URI"]
    return {
        "record_id": identifier,
        "page_id": page_of(identifier),
        "url": None if uri == identifier else uri,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"].strip("<>")) if is_revisit else None,
        "payload": None if is_revisit else payload,
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": digest,
    }, end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(archive: bytes) -> list[tuple[int, int, int]]:
    """Start, length and decompressed length of each frame, from the seek table at the end."""
    count, descriptor, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE or descriptor:
        raise ValueError("the bundle has no seek table that is known here")
    table = archive[-9 - 8 * count : -9]
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    if at + len(table) + 17 != len(archive):
        raise ValueError("the seek table does not cover the bundle")
    return out


def read_frame(archive: bytes, frame: int) -> bytes:
    at, packed, plain = frames_of(archive)[frame]
    return zstandard.ZstdDecompressor().decompress(archive[at : at + packed], max_output_size=plain)


def fetch(archive: bytes, frame: int, offset: int) -> dict:
    """One record by its place in the index; only its frame is decompressed."""
    return read_record(read_frame(archive, frame), offset)[0]


class _Bundle:
    def __init__(self) -> None:
        self.frames, self.sizes, self.index, self.open, self.open_bytes, self.total = [], [], [], [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress

    def add(self, identifier: str, record: bytes) -> None:
        self.index.append({"record_id": identifier, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)
        self.total += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            self.frames.append(self.pack(plain))
            self.sizes.append((len(self.frames[-1]), len(plain)))
            self.open, self.open_bytes = [], 0

    def row(self) -> dict:
        self.close_frame()
        archive = b"".join([*self.frames, seek_table(self.sizes)])
        return {"bundle": hashlib.sha256(archive).hexdigest(), "archive": archive, "index": self.index}


_BUNDLE_ARROW = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])
_RECORD_ARROW = pa.schema([("bundle", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = _Bundle()
    for batch in batches:
        for start in range(0, batch.num_rows, _BATCH):
            for r in batch.slice(start, _BATCH).to_pylist():
                bundle.add(record_id(r["page_id"]), write_record(r["page_id"], r["url"], r["payload"] or b"", r["is_revisit"], r["refers_to"]))
                if bundle.total >= BUNDLE_BYTES:
                    yield pa.RecordBatch.from_pylist([bundle.row()], _BUNDLE_ARROW)
                    bundle = _Bundle()
    if bundle.index:
        yield pa.RecordBatch.from_pylist([bundle.row()], _BUNDLE_ARROW)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            name, archive = batch.column("bundle")[i].as_py(), batch.column("archive")[i].as_py()
            unpack = zstandard.ZstdDecompressor()
            for at, packed, plain in frames_of(archive):
                data, offset, rows = unpack.decompress(archive[at : at + packed], max_output_size=plain), 0, []
                while offset < len(data):
                    fields, offset = read_record(data, offset)
                    rows.append({"bundle": name, **fields})
                yield pa.RecordBatch.from_pylist(rows, _RECORD_ARROW)


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, is_revisit and refers_to of each page.

    The smallest id of each repeated payload is found from digests alone and written, so the join that
    brings it back has an exchange on either side and Spark can split the partitions of a payload that
    very many pages share.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_key", F.unhex(F.sha2(F.col("payload"), 256)))
    groups = rows.where(F.length("payload") >= min_bytes).groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    repeated = written(groups.where("_n > 1").select(F.col("_key").alias("_k"), "_first"), "warc-first")
    joined = rows.join(repeated.hint("shuffle_merge"), F.col("_key") == F.col("_k"), "left")
    is_revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", is_revisit.alias("is_revisit"), F.when(is_revisit, F.col("_first")).alias("refers_to"))


def write_bundles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The table of bundles, written to the shared folder."""
    return written(with_roles(pages, min_bytes).mapInArrow(_pack, BUNDLE_TYPE), "warc-bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of a table of bundles."""
    return bundles.select("bundle", "archive").mapInArrow(_unpack, RECORD_TYPE)


def index_of(bundles: DataFrame) -> DataFrame:
    """One row per record: where its bytes are."""
    return bundles.select("bundle", F.inline("index"))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            name, archive = batch.column("bundle")[i].as_py(), batch.column("archive")[i].as_py()
            rows, held, data = [], None, b""
            for place in sorted(batch.column("places")[i].as_py(), key=lambda p: (p["frame"], p["offset"])):
                if place["frame"] != held:
                    held, data = place["frame"], read_frame(archive, place["frame"])
                rows.append({"bundle": name, **read_record(data, place["offset"])[0]})
            yield pa.RecordBatch.from_pylist(rows, _RECORD_ARROW)


def lookup(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of pages (``page_id``), found through the index; only frames that hold one are decompressed."""
    wanted = page_ids.select(F.coalesce(F.concat(F.lit("urn:x-page:"), F.col("page_id").cast("string")), F.lit("urn:x-page:none")).alias("record_id")).distinct()
    places = index_of(bundles).join(wanted, "record_id", "left_semi").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))
    return bundles.select("bundle", "archive").join(places, "bundle").mapInArrow(_looked_up, RECORD_TYPE)


def record_rows(records: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
