"""WARC archives whose records are Zstandard frames over a dictionary of their own.

Each archive starts with a skippable frame that holds a dictionary built from a bounded
sample of its records; every record is a frame by itself, so records can be read alone.
Records with equal payloads are stored once: the one with the largest page_id is the
response, the others revisit it.

An archive is one value of a stored table: Spark commits whole tasks, and a lost executor
leaves no half-written archive. ``export_archives`` writes them as files.

Defined cases: a null payload is empty; a null url leaves the target out; a null page_id
is smaller than any; rows that share both payload and largest page_id are all responses;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmason.llm.common import bound_batches, join_salted
from textmason.session import cut_lineage, file_system

SKIPPABLE = 0x184D2A5D
#: An archive is closed beyond so many bytes of records.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is built from at most so many bytes of records, and has this size.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
LEVEL = 3
#: Parts that rows with one digest are dealt to.
SALTS = 64


def _record(row: dict, date: str) -> bytes:
    payload = row["payload"]
    revisit = row["refers_to"] is not None
    name = "none" if row["page_id"] is None else str(row["page_id"])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["url"] is not None:
        target = row["url"].replace("\r", "%0D").replace("\n", "%0A")
        head.append(f"WARC-Target-URI: {target}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:x-page:{row['refers_to']}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from a bounded sample; raw content where there is too little to train on."""
    sample, size = [], 0
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for record in records[::step]:
        sample.append(record[: 128 << 10])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def write_archive(records: list[bytes]) -> bytes:
    dictionary = build_dictionary(records)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
    frames = [struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary]
    frames += [compressor.compress(record) for record in records]
    return b"".join(frames)


def read_archive(data: bytes) -> list[dict]:
    """Headers and block of each record."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive lacks its dictionary frame")
    dictionary = data[8 : 8 + size]
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(
        data[8 + size :], read_across_frames=True
    )
    plain = reader.read()
    out, at = [], 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        out.append({"headers": headers, "block": plain[start:stop]})
        at = stop + 4
    return out


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): which record each page revisits, if any.

    Only digests seen twice take part in the join, which is dealt to ``SALTS`` parts a digest.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.concat_ws("-", F.sha1("payload"), F.octet_length("payload")))
    copies = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .filter("n > 1 AND largest IS NOT NULL")
        .select("digest", "largest")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    joined = join_salted(rows, copies, ["digest"], F.struct("page_id", "url"), SALTS)
    return joined.select(
        "page_id", "url", "payload", refers.alias("refers_to")
    )


def write_archives(records: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Store (n_records, archive) for rows of ``with_revisits``; returns the stored table."""

    def write(batches):
        held, size = [], 0

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([len(held)], pa.int64()), pa.array([write_archive(held)], pa.binary())],
                names=["n_records", "archive"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    held.append(_record(row, date))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        held, size = [], 0
        if held:
            yield closed()

    return cut_lineage(records.mapInArrow(write, "n_records BIGINT, archive BINARY"))


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if text == "none" else int(text)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per stored record; a response's payload is read and digested again."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                columns = [[], [], [], [], []]
                for record in read_archive(data):
                    headers = record["headers"]
                    http, _, payload = record["block"].partition(b"\r\n\r\n")
                    if headers["WARC-Type"] == "response":
                        length = len(payload)
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        refers = None
                    else:
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = _page(headers["WARC-Refers-To"])
                    page = _page(headers["WARC-Record-ID"])
                    for column, value in zip(columns, (page, length, digest, headers["WARC-Type"], refers)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return archives.select("archive").mapInArrow(
        read,
        "page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT",
    )


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive to ``folder`` (shared by all executors) under its SHA-256; returns the names.

    A repeated task writes the same bytes under the same name.
    """

    def export(batches):
        for batch in batches:
            names = []
            for data in batch.column(0).to_pylist():
                names.append(f"{folder}/{hashlib.sha256(data).hexdigest()}.warc.zst")
                fs, plain = file_system(names[-1])
                fs.create_dir(plain.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(plain) as stream:
                    stream.write(data)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["uri"])

    return cut_lineage(archives.select("archive").mapInArrow(export, "uri STRING"))
