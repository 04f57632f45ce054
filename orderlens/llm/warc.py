"""WARC archives: write, read, and revisit resolution by payload digest.

Headers (id, digest, length; no payload) are shuffled by digest; of records with
equal payloads of at least ``min_bytes`` the one with the smallest id is a response
and the others revisit it. ``write_archives`` writes both with fresh headers:
a revisit holds no payload and refers to its response. ``read_archives`` parses the
files again by their lengths, so payloads may hold anything, and checks every
digest. ``resolve`` joins revisits to the responses they refer to.

Files are written by Spark's text writer with the record end of the format (two
line ends) as separator, so any store that Spark writes will do; files are gzip
streams, at most ``FILE_RECORDS`` records each, which bounds what a task reads.

Defined results: a NULL payload is empty. A NULL id makes a response without a
page id that nothing refers to. Rows that repeat the smallest id of a payload are
all responses. Line ends in a URL are removed; a NULL URL gives no header. Further
columns are not read. An empty table writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.session import ship_package

FILE_RECORDS = 2_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

_READ = (
    "record_id long, record_type string, target_uri string, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 8 groups of 20, each four letters.

    The hash and the number of each group are bound by lambdas: written out, Spark hashes the payload anew for every letter.
    """

    def letters(number: Column) -> Column:
        values = [F.shiftright(number, shift).bitwiseAND(31) for shift in (15, 10, 5, 0)]
        return F.concat(*[F.substring(F.lit(BASE32), value + 1, F.lit(1)) for value in values])

    def written(digest: Column) -> Column:
        numbers = [F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int") for group in range(8)]
        return F.array_join(F.transform(F.array(*numbers), letters), "")

    return F.when(payload.isNotNull(), F.get(F.transform(F.array(F.sha1(payload)), written), F.lit(0)))


def records_of(df: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    """(record_id, target_uri, payload, payload_bytes, payload_digest) of any table."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return df.select(
        F.col(record_id).cast("long").alias("record_id"),
        F.translate(F.col(url).cast("string"), "\r\n", "").alias("target_uri"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        sha1_base32(body).alias("payload_digest"),
    )


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with record_type and refers_to (the response's id and URL for revisits)."""
    first = (
        records.filter((F.col("payload_bytes") >= min_bytes) & F.col("record_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct("record_id", "target_uri")).alias("first"), F.max("record_id").alias("last"))
        .filter(F.col("last") > F.col("first.record_id"))
        .drop("last")
    )
    named = (
        records.filter("record_id is not null")
        .join(first, ["payload_digest", "payload_bytes"], "left")
        .unionByName(records.filter("record_id is null").withColumn("first", F.lit(None).cast(first.schema["first"].dataType)))
    )
    again = F.coalesce(F.col("record_id") > F.col("first.record_id"), F.lit(False))
    return named.select(
        *records.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.record_id")).alias("refers_to"),
        F.when(again, F.col("first.target_uri")).alias("refers_to_uri"),
    )


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), record_id.cast("string"), F.lit(">"))


def write_archives(marked: DataFrame, path: str, date: datetime | None = None) -> None:
    """Write marked records as gzip WARC files with headers made anew."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\n"),
        _header("WARC-Record-ID", _urn(F.col("record_id"))),
        F.lit(f"WARC-Date: {stamp}\r\n"),
        _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        _header("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_to_uri"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )
    (
        marked.select(record.alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; names in lower case."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.find(end, at)
        if stop < 0:
            raise ValueError("a record without an end of its headers")
        first, *rest = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        headers = {}
        for line in rest:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = stop + len(end)
        size = int(headers["content-length"])
        if start + size + len(end) > len(data):
            raise ValueError("a record is cut short")
        yield headers, data[start : start + size]
        at = start + size + len(end)


def _number(urn: str | None) -> int | None:
    return int(urn.rpartition(":")[2].rstrip(">")) if urn else None


def _parse(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("record_id", pa.int64()),
            ("record_type", pa.string()),
            ("target_uri", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload", pa.binary()),
        ]
    )
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in parse_records(gzip.decompress(content.as_py())):
                response = headers["warc-type"] == "response"
                payload = block[block.find(b"\r\n\r\n") + 4 :] if response else None
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {headers.get('warc-record-id')} does not fit its digest")
                rows.append(
                    (
                        _number(headers.get("warc-record-id")),
                        headers["warc-type"],
                        headers.get("warc-target-uri"),
                        _number(headers.get("warc-refers-to")),
                        digest,
                        len(payload) if response else None,
                        payload if payloads else None,
                    )
                )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``; a revisit has no payload of its own."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(partial(_parse, payloads=payloads), _READ)


def resolve(read: DataFrame) -> DataFrame:
    """Records as read, revisits with the payload and length of the response they refer to."""
    own = read.filter("record_type = 'response'")
    source = own.filter("record_id is not null").select(
        F.col("record_id").alias("refers_to"),
        "payload_digest",
        F.col("payload_bytes").alias("full_bytes"),
        F.col("payload").alias("full_payload"),
    ).dropDuplicates(["refers_to", "payload_digest"])
    again = (
        read.filter("record_type = 'revisit'")
        .join(source, ["refers_to", "payload_digest"], "left")
        .withColumns({"payload_bytes": F.col("full_bytes"), "payload": F.col("full_payload")})
    )
    return own.unionByName(again.select(*own.columns))
