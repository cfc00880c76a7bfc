"""WARC archives with a Zstandard dictionary, written and read by Spark.

An archive (``.warc.zst``) is one leading skippable frame that holds a dictionary built
from its own records, then one compressed frame for each record. Spark's text sink writes
the files, so their commit and their retry after a lost executor are Spark's: a row is
one frame, and the sink's line separator is an empty skippable frame, which every reader
passes over. The source ``binaryFile`` brings them back, one archive to a row.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the largest
page id is a response, the others are revisits that refer to it. Only digests are
aggregated and joined; a payload that half of the pages share is one row there, and the
pages that join it are split by adaptive execution.

Defined cases: a null payload counts as empty, a null url gives a record without target.
Rows with the same largest id are responses all. A group whose ids are all null has
responses only. An empty table writes no archive and reads back empty. Payloads are kept
whole. Other input columns are not archived.
"""

from __future__ import annotations

import base64
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVISIT_BYTES = 1000
#: Records that an archive's dictionary is built from: as many as come first in so many bytes.
TRAINING_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to, refers_url) of every page."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")}
    )
    large = base.filter(F.col("size") >= REVISIT_BYTES).select("digest", "page_id", "url")
    shared = (
        large.groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.max_by("url", "page_id").alias("kept_url"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("kept").isNotNull())
        .drop("n")
    )
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return base.join(shared, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        "size",
        F.when(other, F.col("kept")).alias("refers_to"),
        F.when(other, F.col("kept_url")).alias("refers_url"),
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _plain(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC record; a revisit has the response's headers and no payload."""
    revisit = row["refers_to"] is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = head if revisit else head + row["payload"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(row['page_id'], row['digest'])}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_plain(row['url'])}")
    if row["page_id"] is not None:
        lines.append(f"Page-Id: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'], row['digest'])}", f"Refers-To-Page-Id: {row['refers_to']}"]
        if row["refers_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_plain(row['refers_url'])}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]):
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(found: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: dictionary first."""
    import zstandard

    first, size = [], 0
    for record in found:
        first.append(record)
        size += len(record)
        if size >= TRAINING_BYTES:
            break
    if not first:
        return
    dictionary = build_dictionary(first)
    raw = dictionary.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    for record in first:
        yield packer.compress(record)
    first.clear()
    for record in found:
        yield packer.compress(record)


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", **columns: str) -> None:
    """Archives every page under ``path``, one archive for each task."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[bytes]:
            for batch in rows:
                for at in range(0, batch.num_rows, 64):
                    for row in batch.slice(at, 64).to_pylist():
                        yield record_bytes(row, date)

        held, size = [], 0
        for frame in frames(each()):
            held.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    packed = records(pages, **columns).mapInArrow(batches, "frame binary")
    # The cast keeps the bytes as they are; the sink writes them unchanged.
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("ascii")).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(record headers, HTTP headers, payload) of each record of an archive."""
    import zstandard

    if not archive:  # a task without rows
        return
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    raw = archive[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    stream = io.BufferedReader(unpacker.stream_reader(io.BytesIO(memoryview(archive)[8 + size :]), read_across_frames=True), 1 << 20)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {version[:20]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        head, _, payload = block.partition(b"\r\n\r\n")
        yield headers, head, payload


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``; a revisit's payload is null.

    Digest and size of a response are those of the payload as read; those of a revisit
    are what its headers say of the payload it stands for.
    """
    import hashlib

    def whole(number: str | None) -> int | None:
        return None if number is None else int(number)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                made, size = [], 0
                for headers, head, payload in parse(batch.column(0)[i].as_py()):
                    told = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    revisit = headers["WARC-Type"] == "revisit"
                    if revisit:
                        lengths = [x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")]
                        n, digest = int(lengths[0]), told
                    else:
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != told:
                            raise ValueError(f"page {headers.get('Page-Id')}: the payload does not have its digest")
                    made.append(
                        (
                            whole(headers.get("Page-Id")),
                            headers.get("WARC-Target-URI"),
                            n,
                            digest,
                            headers["WARC-Type"],
                            whole(headers.get("Refers-To-Page-Id")),
                            None if revisit or not payloads else payload,
                        )
                    )
                    size += len(payload) if payloads else 200
                    if size >= 4 << 20:
                        yield _batch(made)
                        made, size = [], 0
                if made:
                    yield _batch(made)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(batches, READ)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], READ.names)
