"""Operator 2: WARC records in seekable Zstandard bundles.

Pages become WARC 1.1 records, several records make a frame that decompresses by itself, frames make
a bundle, and a bundle ends in the seek table of the seekable format (a skippable frame with each
frame's compressed and decompressed size). An index maps a record's identifier to its frame and its
offset in the decompressed frame, so a record is read by decompressing one frame.

Equal payloads of at least MIN_DEDUP bytes are stored once: the row with the smallest page_id is a
response and the others are revisit records, whose block has the HTTP headers alone.

Defined cases: a null html is an empty payload; smaller payloads are all responses; rows that repeat
the smallest page_id of a payload are all responses; a null page_id is after all others and its
record's identifier is "null"; an empty table gives no bundles; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, checkpointed, table

MIN_DEDUP = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 22
LEVEL = 3
SALTS = 16
#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE, SEEKABLE, DATE = 0x184D2A5E, 0x8F92EAB1, "2026-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A WARC record: a response with its payload, or a revisit where refers_to is set."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames; ``close`` gives the archive and its index."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.open, self.open_size = frame_bytes, [], 0
        self.frames, self.sizes, self.index = [], [], []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    @property
    def size(self) -> int:
        return sum(n for _, n in self.sizes) + self.open_size

    def add(self, key: str, data: bytes) -> None:
        if self.open and self.open_size + len(data) > self.frame_bytes:
            self.flush()
        self.index.append((key, len(self.sizes), self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)

    def flush(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            packed = self.packer.compress(raw)
            self.frames.append(packed)
            self.sizes.append((len(packed), len(raw)))
            self.open, self.open_size = [], 0

    def close(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(footer)) + footer, self.index


class BundleReader:
    """Reads records of an archive by frame and offset; needs no more than the archive's bytes."""

    def __init__(self, archive: bytes):
        count, flags, magic = struct.unpack("<IBI", archive[-9:])
        if magic != SEEKABLE:
            raise ValueError("the archive has no seek table")
        each = 12 if flags & 0x80 else 8
        table_at = len(archive) - 9 - each * count
        if struct.unpack("<II", archive[table_at - 8 : table_at]) != (SKIPPABLE, each * count + 9):
            raise ValueError("the seek table is broken")
        self.archive, self.at, self.known = archive, [0], (-1, b"")
        self.sizes = [struct.unpack("<II", archive[table_at + each * i : table_at + each * i + 8]) for i in range(count)]
        for packed, _ in self.sizes:
            self.at.append(self.at[-1] + packed)

    def frame(self, k: int) -> bytes:
        if self.known[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.archive[self.at[k] : self.at[k + 1]], max_output_size=self.sizes[k][1])
            if len(raw) != self.sizes[k][1]:
                raise ValueError("a frame's size is not that of the seek table")
            self.known = (k, raw)
        return self.known[1]

    def read(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP head, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block, end = rest[: (n := int(headers["Content-Length"]))], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): what each page's record is to be.

    The first holder of a payload is a minimum, summed up before the shuffle. The join back is on
    digest and salt, so that copies of one payload are dealt over SALTS tasks.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    first = (
        pages.select("page_id", html.alias("html")).where(F.octet_length("html") >= MIN_DEDUP)
        .groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    rows = rows.withColumn("_pick", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("_pick") == F.col("_salt")), "left")
    later = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("payload_bytes") >= MIN_DEDUP)
    return joined.select(
        "page_id", "url", F.when(later, "").otherwise(F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(later, F.col("_first")).alias("refers_to")
    )


BUNDLE_SCHEMA = "archive binary, keys array<string>, frames array<int>, offsets array<int>, lengths array<int>"


def _bundle(writer: BundleWriter) -> pa.RecordBatch:
    archive, index = writer.close()
    keys, frames, offsets, lengths = zip(*index, strict=True)
    i32 = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([archive], pa.binary()), pa.array([list(keys)], pa.list_(pa.string())), *[pa.array([list(x)], i32) for x in (frames, offsets, lengths)]],
        ["archive", "keys", "frames", "offsets", "lengths"],
    )


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = BundleWriter()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256).to_pydict()
            for page_id, url, html, size, digest, refers in zip(*part.values(), strict=True):
                writer.add("null" if page_id is None else str(page_id), record(page_id, url, html.encode(), size, digest, refers))
                if writer.size >= BUNDLE_BYTES:
                    yield _bundle(writer)
                    writer = BundleWriter()
    if writer.index:
        yield _bundle(writer)


def write_bundles(pages: DataFrame) -> DataFrame:
    """Bundles with their index, a row each, of at most about BUNDLE_BYTES of records."""
    return arrow_map(page_records(pages), _write, BUNDLE_SCHEMA)


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda urn: None if (x := urn.rpartition(":")[2].rstrip(">")) == "null" else int(x)
    for batch in batches:
        for b in range(batch.num_rows):
            one = batch.slice(b, 1).to_pylist()[0]
            reader, rows = BundleReader(one["archive"]), []
            for key, frame, offset, length in zip(one["keys"], one["frames"], one["offsets"], one["lengths"], strict=True):
                headers, http, payload = parse(reader.read(frame, offset, length))
                if headers["WARC-Record-ID"] != f"<urn:page:{key}>":
                    raise ValueError("the index names another record")
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError("a payload is not what its record says")
                refers = headers.get("WARC-Refers-To")
                rows.append((number(headers["WARC-Record-ID"]), size, digest, kind, number(refers) if refers else None, headers["WARC-Target-URI"]))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORD_SCHEMA.split(", ")])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row for each record of the bundles, checked against its digest."""
    return arrow_map(bundles, _read, RECORD_SCHEMA)


def op2_warc_bundles(spark, sf_dir: str) -> DataFrame:
    written = checkpointed(write_bundles(table(spark, sf_dir, "pages")))
    return read_bundles(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest AS pd, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f ON payload_digest = pd AND payload_bytes >= 100
"""
