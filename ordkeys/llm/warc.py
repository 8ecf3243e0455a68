"""WARC archives of captures: writing, reading back, and assembly of transactions.

A capture gives three records: request, response (or revisit), metadata. Request and
metadata name the response in WARC-Concurrent-To; assembly joins the three through it
into one nested row.

Archives are gzipped WARC/1.1 files written by Spark's text sink, with the blank lines
that end a record as its line separator. So they go wherever Spark can write.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordkeys.llm.common import hot_join, materialize, new_path

#: What ends a record, after its block.
RECORD_END = "\r\n\r\n"
#: Bytes of payloads that an archive file holds on average, and most records of one; a reading task holds one file.
FILE_BYTES, FILE_RECORDS = 16_000_000, 20_000
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 0
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes bigint, payload binary, fields map<string,string>"
)


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 given in hex: 40 hex digits are 8 groups of 5, each 4 letters."""
    def letters(group: Column) -> Column:
        n = F.conv(group, 16, 10).cast("long")
        return F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(n, s) % 32 + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[letters(F.substring(digest, 1 + 5 * i, 5)) for i in range(8)])


def _id(kind: str, *parts: Column) -> Column:
    """A record id that follows from the capture."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Fields whose value is null are left out; line breaks in a value become blanks."""
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_replace(v, r"[\r\n]+", " ")) for k, v in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, length), F.lit("\r\n\r\n"), block)


def capture_roles(captures: DataFrame, *, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Of captures with equal payloads, the one with the largest page_id is the response.

    captures: page_id, url, html. Returns row (a number of its own for each capture),
    page_id, url, payload_bytes, digest (hex SHA-1), same (SHA-256), and response
    (page_id, row and url of the response, null where the capture itself is one).

    Equal payloads are found by SHA-256. Payloads aren't carried along: the largest id
    of each is pre-aggregated before the shuffle, ids and digests meet in the join,
    which deals a frequent one to several tasks. Rows that share the largest id are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = materialize(
        captures.select(
            F.monotonically_increasing_id().alias("row"), "page_id", "url",
            F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"), F.sha2(payload, 256).alias("same"),
        ),
        "captures",
    )
    first = known.groupBy("same").agg(F.max(F.struct("page_id", "row", "url")).alias("first"))
    own = (F.col("payload_bytes") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return hot_join(known, first, "same", "row").select("row", "page_id", "url", "payload_bytes", "digest", "same", F.when(~own, F.col("first")).alias("response"))


def records(captures: DataFrame, *, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """The records of captures as text, one a row: those that hold a payload, with its bytes; and all others.

    Payloads are shuffled pre-aggregated, so that one which many captures share goes
    once from each task; captures that are responses take theirs in a join.
    """
    c = materialize(capture_roles(captures, min_revisit_bytes=min_revisit_bytes), "roles")
    html = F.coalesce(F.col("html"), F.lit(""))
    payloads = captures.select(html.alias("html")).groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("same")).agg(F.first("html").alias("html"))
    uri = F.coalesce(F.col("url"), F.lit("about:blank"))
    of = lambda kind: _id(kind, F.col("row"), F.col("page_id"), F.col("url"), F.col("digest"))
    capture = of("response")
    revisit = F.col("response").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(DATE))]

    def main(kind: str, more: list[tuple[str, Column]], block: Column) -> Column:
        digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))
        fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", capture), *common, ("WARC-Payload-Digest", digest), *more, ("Content-Type", F.lit("application/http; msgtype=response"))]
        return _record(fields, block)

    first = F.col("response")
    revisits = main(
        "revisit",
        [
            ("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ("WARC-Refers-To", _id("response", first["row"], first["page_id"], first["url"], F.col("digest"))),
            ("WARC-Refers-To-Target-URI", F.coalesce(first["url"], F.lit("about:blank"))),
        ],
        head,
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", of("request")), ("WARC-Concurrent-To", capture), *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.regexp_replace(uri, r"\s", "+"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", of("metadata")), ("WARC-Concurrent-To", capture), *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("\r\n", F.concat(F.lit("page_id: "), F.col("page_id").cast("string")), F.lit("fetched: yes")),
    )
    responses = c.filter(~revisit).join(payloads.hint("merge"), "same").select(main("response", [], F.concat(head, F.col("html"))).alias("value"), "payload_bytes")
    others = c.select(F.explode(F.array_compact(F.array(request, F.when(revisit, revisits), metadata))).alias("value"))
    return responses, others


def write_archives(captures: DataFrame, path: str, *, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write the captures' records as WARC files below path: those with payloads in one folder, the others in another.

    A file of payloads holds as many as take file_bytes on average. The sink's own
    commit makes the files whole or absent when an executor is lost.
    """
    responses, others = records(captures, min_revisit_bytes=min_revisit_bytes)
    mean = captures.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    most = max(1, min(file_records, int(file_bytes / (mean + 1_000))))
    for name, rows, n in (("payloads", responses.select("value"), most), ("others", others, file_records)):
        rows.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", n).option("compression", "gzip").text(f"{path}/{name}")


def open_archive(content: bytes) -> BinaryIO:
    """A stream over an archive; gzip, of one member or one a record, is undone as it is read."""
    plain = io.BytesIO(content)
    return gzip.GzipFile(fileobj=plain) if content.startswith(b"\x1f\x8b") else plain


def parse_records(archive: BinaryIO) -> Iterator[dict]:
    """The records of one archive, one after the other. Content-Length alone decides where a block ends, so a payload may hold anything."""
    while line := archive.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record's fields are cut off")
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        length = int(fields["content-length"])
        block = archive.read(length)
        if len(block) < length:
            raise ValueError(f"{fields.get('warc-record-id')}: the block is cut off")
        yield {"fields": fields, "block": block}


def _row(record: dict) -> dict:
    fields, block = record["fields"], record["block"]
    kind = fields.get("warc-type")
    payload, n_bytes, digest = block, len(block), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http = fields.get("content-type", "").startswith("application/http")
    if http:
        head, _, payload = block.partition(b"\r\n\r\n")
        lengths = re.findall(rb"(?im)^content-length:\s*(\d+)", head)
        n_bytes = int(lengths[0]) if kind == "revisit" and lengths else len(payload)
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest not in (None, found):
            raise ValueError(f"{fields.get('warc-record-id')}: the payload's digest is {found}, not {digest}")
        digest = found
    extra = {}
    if kind == "metadata":
        for line in block.decode("utf-8", "replace").splitlines():
            name, sep, value = line.partition(":")
            if sep:
                extra[name.strip()] = value.strip()
    return {
        "record_id": fields.get("warc-record-id"), "type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_digest": digest, "payload_bytes": n_bytes,
        "payload": None if kind == "revisit" else payload, "fields": extra,
    }


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of the WARC files below path: RECORDS. Without payloads that column is null; digests and sizes are still of the whole payload.

    Files come through Spark's binaryFile source; a task holds one file at a time.
    Digests of responses are checked; a damaged archive is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    kinds = [
        *[(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")],
        ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(kinds)
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in parse_records(open_archive(content.as_py())):
                    row = _row(record)
                    row["payload"] = row["payload"] if payloads else None
                    row["fields"] = list(row["fields"].items())
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 5_000 or held > FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORDS)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response, metadata, copies.

    rows: RECORDS. Each record belongs to the one that it is concurrent to, else to
    itself. ``response`` holds the response or revisit record. A capture without one
    of the records has null there. Captures written more than once, record by
    record the same, come as one row with the number of copies.

    One shuffle by capture; a capture has three records, however many captures share
    a payload or host. Equal records are counted before the shuffle.
    """
    keep = ["record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "payload", "fields"]
    one = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.struct(*keep)), ignorenulls=True)
    return (
        rows.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
        .groupBy("capture")
        .agg(
            one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"),
            F.count(F.when(F.col("type").isin("response", "revisit"), 1)).alias("copies"),
        )
        .withColumnRenamed("capture", "record_id")
    )


def with_originals(captures: DataFrame) -> DataFrame:
    """Assembled captures with ``original``: what a revisit refers to by its WARC-Refers-To.

    original: record_id, target_uri, fields of its metadata; null for captures that are
    no revisits, and where the original isn't there. The join is by record id; captures
    that are no revisits have a key of their own, and the revisits of one original are
    dealt to several tasks. captures should be written, as it is read more than once.
    """
    known = captures.filter(F.col("response.type") == "response").select(
        F.col("record_id").alias("__refers"), F.struct("record_id", "response.target_uri", "metadata.fields").alias("original"))
    refers = F.coalesce(F.col("response.refers_to"), F.concat(F.lit("-"), "record_id"))
    return hot_join(captures.withColumn("__refers", refers), known, "__refers", "record_id", "left").drop("__refers")


def op3_warc_transactions(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = with_originals(materialize(assemble(read_archives(spark, path, payloads=False)), "transactions"))
    page_id = lambda fields: F.try_element_at(fields, F.lit("page_id")).cast("long")
    return captures.select(
        page_id("metadata.fields").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"),
        page_id("original.fields").alias("refers_to"), F.col("response.target_uri").alias("target_uri"), F.col("request").isNotNull().alias("has_request"),
    )


# DuckDB's sha1 gives hex; base32 goes by groups of five hex digits, four letters each
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || g)::BIGINT >> {s}) % 32 + 1, 1)"
SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS h, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(list_transform(range(0, 8), lambda k: substr(h, 5 * k + 1, 5)),
         lambda g: {" || ".join(_LETTER.format(s=s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to,
       coalesce(url, 'about:blank') AS target_uri, true AS has_request
FROM d
"""
