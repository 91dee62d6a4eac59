"""WARC archives of web pages, compressed record by record with an embedded Zstandard dictionary."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import publish, shared_dir, text_of, written

#: The skippable frame that holds the dictionary, as the WARC profile for Zstandard has it.
DICTIONARY_MAGIC = 0x184D2A5D
#: A new archive begins after so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is fitted on at most so many records, of so many leading bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 112 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    number = uri[len("<urn:x-page:") : -1] if uri else "null"
    return None if number == "null" else int(number)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, first_url: str | None, date: str) -> bytes:
    """One WARC record; refers_to is the id of the record whose payload this one repeats."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    safe = lambda u: quote(u or "about:blank", safe="!#$%&'()*+,/:;=?@[]~|")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {safe(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}", f"WARC-Refers-To-Target-URI: {safe(first_url)}"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[:DICTIONARY_BYTES] + b"WARC/1.1\r\n" * 2)[:DICTIONARY_BYTES]


def write_archives(records: DataFrame, folder: str, dictionary: bytes, date: str) -> DataFrame:
    """records: page_id, url, html, first_id, first_url, is_first. Out: a row per archive.

    Names hold a mark of the attempt, so what a lost or repeated task has left is in no list.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = zstandard.ZstdCompressionDict(dictionary)
        press = zstandard.ZstdCompressor(level=6, dict_data=kept)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        part, serial, count, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0, bytearray(lead)
        for pages in batches:
            for page, url, html, first, first_url, is_first in pages.itertuples(index=False):
                page, first = (None if x is None else int(x) for x in (page, first))
                out += press.compress(
                    make_record(page, url, (html or "").encode(), None if is_first else record_id(first), first_url, date)
                )
                count += 1
                if len(out) >= ARCHIVE_BYTES:
                    publish(folder, name := f"pages-{part}-{serial:05d}.warc.zst", bytes(out))
                    yield pd.DataFrame({"archive": [name], "n_records": [count], "n_bytes": [len(out)]})
                    serial, count, out = serial + 1, 0, bytearray(lead)
        if count:
            publish(folder, name := f"pages-{part}-{serial:05d}.warc.zst", bytes(out))
            yield pd.DataFrame({"archive": [name], "n_records": [count], "n_bytes": [len(out)]})

    columns = ["page_id", "url", "html", "first_id", "first_url", "is_first"]
    # ids go as text: pandas would turn integers beside nulls into floating point
    as_text = [F.col(c).cast("string").alias(c) if c.endswith("_id") else c for c in columns]
    return records.select(*as_text).mapInPandas(write, "archive string, n_records long, n_bytes long")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of every record; the archive alone is needed."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    kept = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    frames = memoryview(data)[8 + size :]
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=kept).stream_reader(frames, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        stream.read(4)
        yield headers, block


def read_archives(spark, folder: str, archives: DataFrame) -> DataFrame:
    """A row per record of the listed archives in folder, its digest checked against the payload.

    A revisit has no payload; the bytes of the payload it repeats are in its HTTP header. Files
    that the list lacks, left by attempts that were lost, are not read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for data in files["content"]:
                rows = []
                for headers, block in parse_archive(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
                    if headers["warc-type"] == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                            raise ValueError(f"{headers['warc-record-id']} does not match its digest")
                    rows.append(
                        (page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], page_of(headers.get("warc-refers-to")))
                    )
                page, size, digest, kind, refers = zip(*rows, strict=True)
                page, refers = pd.array(page, dtype="Int64"), pd.array(refers, dtype="Int64")
                yield pd.DataFrame(
                    {"page_id": page, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers}
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    # names alone are compared before any content is read; there is one name for ARCHIVE_BYTES of archive
    files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(archives.select("archive"), "archive", "left_semi")
    return files.select("content").mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Every page with the page of the smallest id among those of equal payload."""
    text = text_of("html")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"), F.sha2(text, 256).alias("key"))
    first = base.groupBy("key").agg(
        F.min("page_id").alias("first_id"), F.min_by("url", F.coalesce("page_id", F.lit(2**63 - 1))).alias("first_url")
    )
    first = written(first, "payloads")  # a written side lets adaptive execution split a payload that very many pages share
    alone = F.octet_length("html") < F.lit(least_bytes)
    return base.join(first.hint("merge"), "key").select(
        "page_id", "url", "html", "first_id", "first_url", (alone | F.col("page_id").eqNullSafe(F.col("first_id"))).alias("is_first")
    )


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write every page as a WARC record and read the archives back.

    Pages are grouped by the SHA-256 of their payload (combined before the shuffle); the one of
    the smallest id in a group is a response, the others are revisits of it. A dictionary is
    fitted on a bounded sample (the first SAMPLE_BYTES of SAMPLE_RECORDS pages, those of the least
    hashes; with too few to train on, the samples are the dictionary), stands in a leading
    skippable frame of every archive, and each record, whole, is a frame of its own. Tasks publish
    archives by rename, and only those in the committed list are read.

    Defined cases: null html is an empty payload; a null url becomes about:blank; a null id is
    never the first while another id is there; rows repeated with the smallest id are responses
    each; an empty table gives no archive and no rows; extra columns are ignored.
    Out: page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    n = pages.count()
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not n:
        return spark.createDataFrame([], schema)
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) <= F.lit(int(2e6 * SAMPLE_RECORDS / n))
    sample = pages.where(share).select("page_id", "url", F.substring(text_of("html"), 1, SAMPLE_BYTES).alias("html"))
    sample = sample.orderBy(F.xxhash64("page_id", "url"), "page_id", "url", "html").limit(SAMPLE_RECORDS)
    records = [make_record(r["page_id"], r["url"], r["html"].encode(), None, None, date) for r in sample.collect()]
    archives = write_archives(with_first(pages, least_bytes), folder, fit_dictionary(records), date)
    return read_archives(spark, folder, written(archives, "archives"))
