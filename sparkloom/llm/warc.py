"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent frames, each holding whole records, and two
skippable frames at its end: one that maps record identifiers to (frame, offset in
the frame, length), and the seek table of the seekable format, which gives each
frame's compressed and plain length. Any zstd tool can decompress the bundle; a
reader that knows a record's identifier decompresses one frame. Bundles are binary
values in a Parquet table of the shared folder, so that Spark's committer guards
them and any store that Spark reads can hold them.

Records with equal payloads of at least `least` bytes are stored once: the one with
the largest identifier is the response and the others are revisits that refer to it
(several rows with that same largest identifier are all responses). Null payloads
count as empty ones and null identifiers are kept as such; smaller payloads are
always responses. A very long payload is a frame and a bundle of its own. An empty
table gives no bundles. Only the columns named are read, so further ones can't clash.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SEEK_MAGIC = 0x8F92EAB1
SKIPPABLE = 0x184D2A5E
INDEX_SKIPPABLE = 0x184D2A50
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 8 << 20
NO_ID = -(1 << 63)


def record(ident: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:sparkloom:record:{'none' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(ident)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self._zstd, self._most = zstd.ZstdCompressor(level=level), frame_bytes
        self._done, self._sizes, self._index, self._open, self.size = [], [], [], bytearray(), 0

    def add(self, ident: int | None, raw: bytes) -> None:
        if self._open and len(self._open) + len(raw) > self._most:
            self._close_frame()
        self._index.append((NO_ID if ident is None else ident, len(self._sizes), len(self._open), len(raw)))
        self._open += raw
        self.size += len(raw)

    def _close_frame(self) -> None:
        if self._open:
            self._done.append(c := self._zstd.compress(bytes(self._open)))
            self._sizes.append((len(c), len(self._open)))
            self._open = bytearray()

    def finish(self) -> bytes:
        self._close_frame()
        index = b"".join(struct.pack("<qIII", *x) for x in sorted(self._index))
        table = b"".join(struct.pack("<II", *x) for x in self._sizes)
        table += struct.pack("<IBI", len(self._sizes), 0, SEEK_MAGIC)
        return b"".join([*self._done, struct.pack("<II", INDEX_SKIPPABLE, len(index)), index, struct.pack("<II", SKIPPABLE, len(table)), table])


class BundleReader:
    """Reads the seek table from a bundle's end; decompresses only the frames asked for."""

    def __init__(self, data: bytes):
        frames, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        step = 12 if flags & 0x80 else 8
        at = len(data) - 9 - frames * step
        self._data, self._frames, offset = data, [], 0
        for k in range(frames):
            c, d = struct.unpack_from("<II", data, at + k * step)
            self._frames.append((offset, c, d))
            offset += c
        kind, size = struct.unpack_from("<II", data, offset)
        if kind != INDEX_SKIPPABLE:
            raise ValueError("no record index")
        self.index = list(struct.iter_unpack("<qIII", data[offset + 8 : offset + 8 + size]))
        self._zstd, self._last = zstd.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            offset, c, d = self._frames[k]
            self._last = k, self._zstd.decompress(self._data[offset : offset + c], max_output_size=d)
        return self._last[1]

    def records(self):
        for ident, k, offset, length in sorted(self.index, key=lambda x: x[1:3]):
            yield (None if ident == NO_ID else ident), self.frame(k)[offset : offset + length]

    def get(self, ident: int) -> list[bytes]:
        return [self.frame(k)[o : o + n] for i, k, o, n in self.index if i == ident]


def revisits(pages: DataFrame, ident: str, payload: str, least: int) -> DataFrame:
    """The rows with refers_to (null for responses). Payloads that are too short for a revisit don't move; those of repeated ones are dealt over many tasks."""
    x = pages.withColumn("__key", F.when(F.octet_length(payload) >= least, F.sha2(F.encode(payload, "UTF-8"), 256)))
    long, none = x.where(F.col("__key").isNotNull()), F.lit(None).cast("long").alias("__refers_to")
    first = scratch.written(long.groupBy("__key").agg(F.max(ident).alias("__first"), F.count("*").alias("__n")).where("__n > 1"), "warc-repeats")
    hot = first.where("__n > 1000").orderBy(F.desc("__n"), "__key").limit(1000).select("__key")
    refers = F.when(~F.col(ident).eqNullSafe(F.col("__first")), F.col("__first")).alias("__refers_to")
    long = scratch.salted(long, first.drop("__n"), "__key", hot, [ident], "left")
    return long.select(*pages.columns, refers).unionByName(x.where(F.col("__key").isNull()).select(*pages.columns, none))


def bundles(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Table (bundle, archive): every row of the input as a record, written to the shared folder."""
    rows = revisits(pages.select(F.col(ident).cast("long").alias("__id"), F.col(url).alias("__url"), F.coalesce(payload, F.lit("")).alias("__payload")), "__id", "__payload", least)

    def write(batches):
        task = TaskContext.get().partitionId()
        w, k = BundleWriter(frame_bytes), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{k:06d}"]), pa.array([w.finish()], pa.binary())], names=["bundle", "archive"])

        for b in batches:
            for i, u, p, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = p.encode()
                w.add(i, record(i, u, raw, hashlib.sha1(raw).hexdigest(), r))
                if w.size >= bundle_bytes:
                    yield out()
                    w, k = BundleWriter(frame_bytes), k + 1
        if w.size:
            yield out()

    return scratch.written(rows.select("__id", "__url", "__payload", "__refers_to").mapInArrow(write, "bundle string, archive binary"), "warc", big=True)


def read_back(archives: DataFrame) -> DataFrame:
    """One row for each record of the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, frame_offset."""

    def read(batches):
        for b in batches:
            for bundle, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = BundleReader(data), []
                for ident, k, offset, length in sorted(reader.index, key=lambda x: x[1:3]):
                    f, payload = parse_record(reader.frame(k)[offset : offset + length])
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{bundle}: record {ident} is damaged")
                    refers = int(f["WARC-Refers-To"].rpartition(":")[2].rstrip(">")) if kind == "revisit" else None
                    rows.append((None if ident == NO_ID else ident, int(f["X-Payload-Length"]), digest, kind, refers, bundle, k, offset))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()], strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset"])

    return archives.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long")
