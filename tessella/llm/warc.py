"""WARC archives of Zstandard frames: a dictionary in a leading skippable frame, then one frame for each record.

Writing: each task writes archives of about ``ARCHIVE_BYTES`` of payload; the dictionary is trained on the
archive's first records and stored, itself compressed, in a skippable frame at the start. Of equal payloads of
``REVISIT_FROM`` bytes or more, the page with the largest id is a response, the others are revisits that hold HTTP headers
only and refer to it. Which is which is settled by a pre-aggregated table of digests, whose most frequent are
broadcast, and joined by page id, so neither a frequent payload nor its html meets in one task.

Reading: frames are decoded one at a time from a stream; record type, version, header syntax, Content-Length against
the block, payload digest against the payload, and the size announced for a revisit are all checked.

Archive files are reached by URI through Arrow's file systems (file, hdfs, s3, gs), since Spark has no sink for
binary files. They lie in the shared folder; the table of written archives names those of successful tasks only.

Defined cases: a null html is an empty payload, a null url an empty target; rows that share the largest page_id of
equal payloads are all responses; a page with a null id is always a response and is never referred to; line breaks in
a url are percent-encoded; extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import scratch, staged, with_groups

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_FROM = 1000
ARCHIVE_BYTES = 32_000_000
#: The dictionary of an archive is trained on its first records, about so many bytes, in samples of one size.
TRAINED_BYTES, DICTIONARY_BYTES, LEAST_SAMPLES, SAMPLE_BYTES = 2_000_000, 65_536, 16, 16_384
LEVEL = 3
#: Reading tasks for each core at most; a task reads its archives one after the other.
READS = 64
_HEADER = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*(.*?)[ \t]*\Z", re.S)


class BadRecord(ValueError):
    """An archive that breaks the format."""


def _open(uri: str, how: str):
    system, path = afs.FileSystem.from_uri(uri)
    if how == "r":
        return system.open_input_stream(path, compression=None)  # else the name would have it decompressed
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int) -> bytes:
    """One record: WARC headers, blank line, block, two line ends."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}:{number}')}"
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(uri: str, records: Iterator[bytes], enough: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Write records up to about ``enough`` bytes; returns how many, and the archive's size."""
    first: list[bytes] = []
    size = count = 0
    for record in records:
        first.append(record)
        size += len(record)
        if size >= min(TRAINED_BYTES, enough):
            break
    dictionary = None
    if len(first) >= LEAST_SAMPLES:
        try:
            samples = [x[at : at + SAMPLE_BYTES] for x in first for at in range(0, len(x), SAMPLE_BYTES)]
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), samples)
        except zstandard.ZstdError:
            dictionary = None  # too little in common
    raw = dictionary.as_bytes() if dictionary else b""
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(raw) if raw else b""
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
    with _open(uri, "w") as out:
        written = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored) or 8 + len(stored)
        for record in first:
            frame = compressor.compress(record)
            out.write(frame)
            written += len(frame)
            count += 1
        while size < enough and (record := next(records, None)) is not None:
            frame = compressor.compress(record)
            out.write(frame)
            size, written, count = size + len(record), written + len(frame), count + 1
    return count, written


def _dictionary(head: bytes, stream) -> zstandard.ZstdCompressionDict | None:
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise BadRecord("no dictionary frame at the start")
    size = struct.unpack("<I", head[4:])[0]
    stored = stream.read(size)
    if len(stored) != size:
        raise BadRecord("the dictionary frame is cut off")
    if not size:
        return None
    raw = zstandard.ZstdDecompressor().decompress(stored) if stored[:4] == b"\x28\xb5\x2f\xfd" else stored
    return zstandard.ZstdCompressionDict(raw)


def read_archive(uri: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decoded frames of an archive, one after the other. What follows a frame is copied, hence short chunks."""
    with _open(uri, "r") as stream:
        dictionary = _dictionary(stream.read(8), stream)
        context = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        pending = stream.read(chunk)
        while pending:
            frame, parts = context.decompressobj(), []
            while True:
                parts.append(frame.decompress(pending))
                if frame.eof:
                    pending = frame.unused_data or stream.read(chunk)
                    break
                pending = stream.read(chunk)
                if not pending:
                    raise BadRecord("the last frame is cut off")
            yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record, after checking them; payload is None for a revisit."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadRecord("not a WARC/1.1 record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        if not (m := _HEADER.match(line)):
            raise BadRecord("a header line cannot be read")
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "surrogatepass")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadRecord(f"{name} is missing")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("Content-Length and block differ")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise BadRecord("no HTTP headers")
    stated = re.search(rb"\r\nContent-Length: *(\d+)", http, re.I)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not digest.startswith("sha1:") or not stated:
        raise BadRecord("record type, digest or length is missing")
    if kind == "revisit":
        if payload or "warc-refers-to" not in fields or fields.get("warc-profile") != REVISIT_PROFILE:
            raise BadRecord("not a revisit of an identical payload")
    elif len(payload) != int(stated[1]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
        raise BadRecord("the payload is not the one announced")
    return fields | {"payload_bytes": int(stated[1]), "payload_digest": base64.b32decode(digest[5:]).hex(), "payload": payload if kind == "response" else None}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; (uri, records, bytes) of each."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"))
    marked = pages.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= REVISIT_FROM)).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    last = staged(marked.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "digests")
    spread = F.sha1(F.col("page_id").cast("string").cast("binary"))
    revisits = with_groups(marked, last, "digest", spread).filter("page_id < refers_to").groupBy(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).agg(F.first("refers_to").alias("refers_to"))
    digest = F.when(F.octet_length("html") >= REVISIT_FROM, F.sha1(F.col("html").cast("binary")))
    # Null ids take part in no revisit; dealing them by their text keeps them from one task.
    key = F.coalesce("page_id", F.xxhash64("url", "html"))
    known = pages.withColumn("_key", key).withColumn("_d", digest)
    told = known.join(revisits.hint("shuffle_hash"), (F.col("_key") == F.col("_page")) & (F.col("_d") == F.col("_digest")) & F.col("page_id").isNotNull(), "left")

    def archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            n = 0
            for pdf in batches:
                for page_id, url, text, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"]):
                    n += 1
                    yield record_bytes(
                        None if pd.isna(page_id) else int(page_id), url, text.encode("utf-8", "surrogatepass"), None if pd.isna(refers_to) else int(refers_to), n
                    )

        left = records()
        while (first := next(left, None)) is not None:
            uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"

            def chained(first=first) -> Iterator[bytes]:
                yield first
                yield from left

            # A generator that ends must not end the shared one, so records are handed over one by one.
            count, size = write_archive(uri, chained())
            yield pd.DataFrame({"uri": [uri], "records": [count], "bytes": [size]})

    # Ids keep their decimal text: pandas would make doubles of a column with nulls.
    texts = told.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return staged(texts.mapInPandas(archived, "uri string, records long, bytes long"), "archives")


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives named by ``archives`` (uri): page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["uri"]:
                rows: list[tuple] = []
                for data in read_archive(uri):
                    r = parse_record(data)
                    rows.append((_page(r["warc-record-id"]), r["payload_bytes"], r["payload_digest"], r["warc-type"], _page(r.get("warc-refers-to")), r.get("warc-target-uri"), *([r["payload"]] * payloads)))
                    if len(rows) >= 2000:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    # One archive is the unit of reading. Names are short, so adaptive execution would put them all into one task; a
    # stated number of partitions is kept: one an archive, until every core has READS of them to go through.
    parts = max(1, min(archives.count(), READS * archives.sparkSession.sparkContext.defaultParallelism))
    return archives.select("uri").repartition(parts).mapInPandas(records, schema)
