"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame.

Writing: tasks write archives through Spark's text writer. A row is a frame, and the line separator is an
empty skippable frame, so a file is a plain sequence of frames on any file system that Spark reaches: first
the skippable frame (magic 0x184D2A5D) with the dictionary, then the records. A file ends after a fixed number
of rows; an archive that reaches its bytes before is filled up with empty rows, so the next one begins a file.
Reading: the dictionary is loaded from the leading skippable frame, each further frame is decoded by
itself, and WARC headers, block lengths and digests are validated.

Null payloads are empty payloads. Rows that repeat an id are records of their own. A null id makes a
record without a page number, which no other record refers to. No rows give archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: frame magics, and the profile of a revisit by equal payload.
DICTIONARY_MAGIC, FRAME_MAGIC, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: The dictionary is trained on so many pages at most, of so many bytes each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768
LEVEL = 3
#: Rows of a file, and bytes of frames after which an archive ends.
FILE_ROWS, FILE_BYTES = 1 << 16, 128 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def train_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the raw bytes of what there is."""
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[:size] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def record(page: int | None, url: str | None, digest: str, length: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP header, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:x-page:{page}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of pages. Of rows with equal payloads of at least min_bytes bytes, that with
    the largest id is a response and the others are revisits of it; smaller ones are all responses."""
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # The largest id of each digest is found before the payloads move; each hot digest sends one row per task.
    first = own.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha1", "first")
    sample = own.filter(F.col("size") > 0).limit(SAMPLE_ROWS).select(F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).collect()
    dictionary = train_dictionary([bytes(r.payload) for r in sample])
    # Who revisits whom is settled on ids and digests; payloads are then met by digest and page, so a hot page is spread.
    revisits = own.select("sha1", "page").distinct().join(first, "sha1").filter(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("sha1").alias("of"), F.col("page").alias("by"), F.col("first").alias("to"))
    frames = own.join(revisits, (F.col("sha1") == F.col("of")) & F.col("page").eqNullSafe(F.col("by")), "left")
    frames = frames.select("page", "url", "size", "to", F.when(F.col("to").isNull(), F.col("payload")).alias("payload"), F.unhex("sha1").alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        out, rows, size = [head], 1, 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for r in b.slice(at, 64).to_pylist():
                    if rows and size >= file_bytes:
                        out += [b""] * (file_rows - rows)
                        rows = file_rows
                    if rows == file_rows:
                        out, rows, size = [*out, head], 1, 0
                    out.append(packer.compress(record(r["page"], r["url"], base64.b32encode(r["digest"]).decode(), r["size"], r["payload"], r["to"])))
                    rows, size = rows + 1, size + len(out[-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frames.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("frame")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", file_rows).text(folder)


def frames_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each decoded from its own frame with the archive's dictionary."""
    view, at, unpacker = memoryview(archive), 0, None
    plain = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError("an archive ends inside a frame header")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ValueError("an archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("a dictionary frame stands after other frames")
                raw = bytes(view[at + 8 : at + 8 + size])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the format lets the dictionary be compressed
                    raw = plain.decompress(raw, max_output_size=1 << 27)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame begins at byte {at}")
        one = (unpacker or plain).decompressobj()
        out = [one.decompress(view[at : at + (1 << 16)])]
        end = at + (1 << 16)
        while not one.eof:
            if end >= len(view):
                raise ValueError("an archive ends inside a frame")
            out.append(one.decompress(view[end : end + (1 << 16)]))
            end += 1 << 16
        at = min(end, len(view)) - len(one.unused_data)
        yield b"".join(out)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record, with version, end and length checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("a record has no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"a header line has no name: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"a record lacks {', '.join(sorted(missing))}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block has {len(rest) - 4} bytes where its header says {size}")
    return fields, rest[:size]


def page_row(raw: bytes) -> dict:
    fields, block = parsed(raw)
    number = lambda x: int(x.removeprefix("<urn:x-page:").removesuffix(">")) if x and x != "<urn:x-page:>" else None
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("a block has no HTTP header")
    length = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError("a payload differs from its length or digest")
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of each record of the archives at path."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for b in batches:
            for content in b.column(0):
                rows = []
                for raw in frames_of(content.as_buffer()):
                    rows.append(page_row(raw))
                    if len(rows) >= 64:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
