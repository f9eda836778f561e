"""Operator 3: WARC archives with a Zstandard dictionary per archive.

Each archive begins with one skippable frame (magic 0x184D2A5D) that embeds a
dictionary built from the archive's own first records; every record is then a
Zstandard frame of its own, compressed with that dictionary, so the whole file is a
plain sequence of frames and a record can be read alone, by record_at() from the
offset that the manifest gives.

Of records with equal payloads of at least ``least`` bytes, the one with the
smallest page_id is a response and the others revisit it; smaller payloads are
all responses.  Payloads are compared by SHA-256 and length.  Only narrow rows
are aggregated, and copies are folded map-side before they meet; what a payload's
copies learn is dealt over ``salts`` tasks, so a payload that a third of all pages
share is no hot spot.

Nulls: a null html is an empty payload; a null url gives no target URI; a row
with a null page_id revisits if a row with an id has its payload, else it is a
response.  Rows that repeat the smallest page_id of a payload are all responses.
An empty table gives no archive.  Further columns are not archived.  A very long
payload is one record, compressed whole in the memory of one task.

An archive is written under a name of its own and counts only once the task that
wrote it succeeded (its manifest row is committed), so retried tasks do no harm.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import fresh_path, partitions, ship, staged

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_LEAST = 100
ARCHIVE_BYTES = 32 << 20
#: Rows that become Python objects at once.
SLICE = 256
DICT_BYTES, SAMPLE_BYTES = 64 << 10, 3 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long, offsets array<long>"
#: At most 63: the salts of a payload are the bits of one long.
SALTS = 32
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_TAG = 0x7061676549640000 << 64


def typed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_LEAST, salts: int = SALTS) -> DataFrame:
    """page_id, url, payload (string), payload_bytes, payload_digest, record_type, refers_to for every row."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    # the smallest page of each payload, once for each salt that its pages have
    first = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
    first = first.agg(F.min("page_id").alias("__first"), F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts"))
    spread = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit(F.col("__salts"), s) == 1)
    first = first.select("__digest", "__bytes", "__first", F.explode(spread).alias("__s"))
    rows = rows.join(first, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes")) & (F.col("__salt") == F.col("__s")), "left")
    again = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return rows.select(
        "page_id", "url", F.when(again, F.lit("")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    value = uuid.uuid4().int & ((1 << 64) - 1) if page_id is None else _TAG | (page_id & (1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 << 64 != _TAG:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary built from the first records, or their raw content where there is too little to train on."""
    import zstandard

    sample, size = [], 0
    for r in records:
        piece = r[: 128 << 10]
        sample.append(piece)
        size += len(piece)
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICT_BYTES:]


def pack(records: list[bytes]) -> tuple[bytes, list[int]]:
    """A whole archive, and the offset of each record's frame in it."""
    import zstandard

    raw = dictionary(records)
    cctx = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    frames = [struct.pack("<II", SKIPPABLE, len(raw)) + raw, *map(cctx.compress, records)]
    return b"".join(frames), list(accumulate(map(len, frames[:-1])))


def record_at(archive: bytes, offset: int) -> bytes:
    """One WARC record, from the dictionary frame and the record's own alone."""
    import zstandard

    _, size = struct.unpack_from("<II", archive)
    dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    return dctx.decompressobj().decompress(memoryview(archive)[offset:])


def unpack(archive: bytes) -> Iterator[tuple]:
    """The rows of an archive; payloads are hashed again, and must match their digests."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    stream = io.BufferedReader(dctx.stream_reader(memoryview(archive)[8 + size :], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        count = int(http.rpartition(b"Content-Length: ")[2])
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != count):
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        yield page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), count, digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if revisit else None, None if revisit else payload


def write(records: DataFrame, path: str) -> DataFrame:
    """Write what typed() returns as archives under ``path``, a URI that all executors reach; returns the manifest."""
    ship(records.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)

        def flush(rows: list[bytes]) -> pa.RecordBatch:
            name, (content, offsets) = f"{top}/{uuid.uuid4().hex}.warc.zst", pack(rows)
            with store.open_output_stream(name, compression=None) as f:
                f.write(content)
            return pa.RecordBatch.from_pydict({"path": [name], "records": [len(rows)], "bytes": [len(content)], "offsets": [offsets]})

        held, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                for row in zip(*(part.column(i).to_pylist() for i in range(7))):
                    one = record(row[0], row[1], row[2].encode(), *row[3:])
                    if held and size + len(one) > ARCHIVE_BYTES:
                        yield flush(held)
                        held, size = [], 0
                    held.append(one)
                    size += len(one)
        if held:
            yield flush(held)

    return staged(records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(work, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives that the manifest lists; payload is null for revisits and where not asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(name) as f:
                    archive = f.read()
                rows, size = [], 0
                for row in unpack(archive):
                    rows.append(row if payloads else (*row[:6], None))
                    size += len(row[6] or b"") * payloads
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return manifest.select("path").repartition(partitions(manifest.sparkSession)).mapInArrow(work, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read those back."""
    path = fresh_path(spark, "warc")
    return read(write(typed(pages), path), path, payloads=False)
