"""WARC archives: writing captures, reading records back and assembling transactions.

A capture is three records: a request, a response (or a revisit of an earlier equal payload) and a
metadata record.  Request and metadata name the capture's record in WARC-Concurrent-To; assembly brings the
three together by that identifier and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.files import open_file, write_file
from corpusloom.sources.storage import fresh_path, materialize

MAX_READERS = 10_000
DATE = "2024-01-01T00:00:00Z"  # archives are reproducible: no clock is read
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:corpusloom:warc")
RECORD_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("record_id", "warc_type", "concurrent_to", "refers_to", "target_uri", "payload_digest")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
RECORD_DDL = (
    "record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, fields map<string,string>, payload_bytes long, payload binary"
)


def _record_id(*parts: object) -> str:
    return f"<{uuid.uuid5(NAMESPACE, repr(parts)).urn}>"


def _clean(value: str) -> str:
    """A header value on one line; where that changes a URL, the metadata record has the URL itself as a JSON string."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def _record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers.items() if v is not None)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode()
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def capture_records(page_id: int | None, url: str | None, payload: bytes, sha1: str, copies: int, keeper: tuple | None) -> list[bytes]:
    """The three records of a capture; ``keeper`` is (page_id, url) of the response that a revisit refers to."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    own = _record_id("capture", page_id, url, digest)
    common = {"WARC-Date": DATE, "WARC-Target-URI": url}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    capture = {"WARC-Type": "revisit" if keeper else "response", "WARC-Record-ID": own, **common}
    if keeper:
        capture |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id("capture", *keeper, digest), "WARC-Refers-To-Target-URI": keeper[1]}
    capture |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    fields = {"copies": str(copies)} | ({} if page_id is None else {"pageId": str(page_id)})
    if url is not None and _clean(url) != url:
        fields["url-json"] = json.dumps(url)
    request = {"WARC-Type": "request", "WARC-Record-ID": _record_id("request", own), **common, "WARC-Concurrent-To": own}
    meta = {"WARC-Type": "metadata", "WARC-Record-ID": _record_id("metadata", own), **common, "WARC-Concurrent-To": own}
    return [
        _record(request | {"Content-Type": "application/http;msgtype=request"}, f"GET {_clean(url or '/')} HTTP/1.1\r\n\r\n".encode()),
        _record(capture, head if keeper else head + payload),
        _record(meta | {"Content-Type": "application/warc-fields"}, "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()),
    ]


def _headers(data: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in data.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def gzip_members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed members of a gzip file, one at a time, from a stream."""
    unpack, parts, data = zlib.decompressobj(31), [], source.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        data = data or source.read(chunk)


def parse_record(data: bytes, with_payload: bool) -> dict:
    """One record as a row of RECORD_SCHEMA; the payload's digest is taken from the bytes where they are there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    row = {
        "record_id": h.get("warc-record-id"),
        "warc_type": h.get("warc-type"),
        "concurrent_to": h.get("warc-concurrent-to"),
        "refers_to": h.get("warc-refers-to"),
        "target_uri": h.get("warc-target-uri"),
        "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "fields": [],
        "payload_bytes": None,
        "payload": None,
    }
    if h.get("content-type") == "application/warc-fields":
        row["fields"] = list(_headers(b"\r\n" + block).items())
    elif row["warc_type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        row["payload_bytes"] = int(_headers(http)["content-length"])
        if row["warc_type"] == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != row["payload_digest"] or len(payload) != row["payload_bytes"]:
                raise ValueError(f"payload differs from its digest: {row['record_id']}")
            row["payload"] = payload if with_payload else None
    return row


def read_records(archives: DataFrame, with_payload: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """All records of the archives whose URIs are in column ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_file(path) as source:
                    for data in gzip_members(source):
                        rows.append(parse_record(data, with_payload))
                        size += len(data) if with_payload else 500
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)

    # A number is given since rows of paths are tiny: by their bytes all would be put into one task.
    return archives.select("path").repartition(max(1, min(archives.count(), MAX_READERS)), "path").mapInArrow(run, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata.

    ``response`` is the response or revisit record.  Records meet by the identifier they name in
    concurrent-to (the capture's own record names none); a capture without a request or metadata has a null there, and
    a request or metadata whose capture is absent has a null response.  Of several requests one is kept.
    """
    part = F.struct(*[c for c in records.columns])
    is_capture = F.col("warc_type").isin("response", "revisit")
    pick = lambda cond, name: F.first(F.when(cond, part), ignorenulls=True).alias(name)
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        pick(is_capture, "response"), pick(F.col("warc_type") == "request", "request"), pick(F.col("warc_type") == "metadata", "metadata")
    )


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def write_captures(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write a capture per page to gzip archives, one file a task; returns (path, n_captures).

    Pages with equal payloads of at least ``min_revisit_bytes`` share one response, that of the smallest page id (null
    ids last); the others become revisits.  Rows that repeat page id, URL and payload are written once, with
    their number in the metadata record.
    """
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        F.sha1(_payload(F.col(html_col))).alias("sha1"),
        F.sha2(_payload(F.col(html_col)), 256).alias("content"),
        F.octet_length(_payload(F.col(html_col))).alias("n_bytes"),
    )
    meta = keyed.select("page_id", "url", "content")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url"))
    groups = materialize(
        meta.groupBy("content").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1").select("content", "first"), "op3-groups"
    )
    repeats = materialize(meta.groupBy("page_id", "url", "content").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "op3-repeats")
    if repeats.isEmpty():
        keyed = keyed.withColumn("copies", F.lit(1))
    else:
        other = repeats.select(*[F.col(c).alias(f"r_{c}") for c in repeats.columns])
        same = F.col("page_id").eqNullSafe(F.col("r_page_id")) & F.col("url").eqNullSafe(F.col("r_url")) & (F.col("content") == F.col("r_content"))
        keyed = keyed.dropDuplicates(["page_id", "url", "content"]).join(other, same, "left")
        keyed = keyed.withColumn("copies", F.coalesce("r_copies", F.lit(1)))
    revisits = (F.col("n_bytes") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = keyed.join(groups, "content", "left").select(
        "page_id", "url", _payload(F.col("html")).cast("binary").alias("payload"), "sha1", F.col("copies").cast("int"),
        revisits.alias("revisit"), F.col("first.page_id").alias("k_page"), F.col("first.url").alias("k_url"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = f"{folder}/capture-{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def records() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for r in batch.to_pylist():
                    count += 1
                    keeper = (r["k_page"], r["k_url"]) if r["revisit"] else None
                    yield from capture_records(r["page_id"], r["url"], r["payload"], r["sha1"], r["copies"], keeper)

        write_file(path, records())
        yield pa.RecordBatch.from_pydict({"path": [path], "n_captures": [count]}, pa.schema([("path", pa.string()), ("n_captures", pa.int64())]))

    return rows.mapInArrow(run, "path string, n_captures long")


def transactions(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, with_payload: bool = True, **columns: str) -> DataFrame:
    """Write pages as WARC captures, read the archives back and return one nested row per input row.

    Columns: page_id, url, payload_bytes, payload_digest (bare base32 SHA-1), record_type, refers_to (page id of the response that a
    revisit refers to), capture_id, response, request, metadata.  The url is the page's own, line ends included.  A null html is an empty payload.  Null page ids count
    as the largest; a null url leaves the target out.  Repeated rows come back as often as they went in.
    Other columns are not read; an empty table gives no row.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "op3-archives")
    archives = materialize(write_captures(pages, folder, min_revisit_bytes, **columns), "op3-manifest")
    captures = materialize(assemble(read_records(archives.where("n_captures > 0"), with_payload)), "op3-captures")
    page = F.expr("cast(metadata.fields['pageid'] as bigint)")
    originals = captures.where(F.col("response.warc_type") == "response").select(F.col("capture_id").alias("original"), page.alias("refers_to"))
    found = captures.join(originals, F.col("response.refers_to") == F.col("original"), "left")
    rows = found.select(
        page.alias("page_id"),
        F.coalesce(F.get(F.from_json(F.concat(F.lit("["), F.expr("metadata.fields['url-json']"), F.lit("]")), "array<string>"), 0), F.col("response.target_uri")).alias("url"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        "refers_to",
        "capture_id",
        "response",
        "request",
        "metadata",
        F.expr("sequence(1, cast(metadata.fields['copies'] as int))").alias("copy"),
    )
    return rows.withColumn("copy", F.explode("copy")).drop("copy")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT >> 15) & 31)::INT + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT >> 10) & 31)::INT + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT >> 5) & 31)::INT + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM k
"""
