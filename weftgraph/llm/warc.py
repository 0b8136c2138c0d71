"""WARC archives: writing with segments and chunked framing, and reassembly of what is read back.

Every archive is a gzip text file that Spark writes and reads as a stream; one task reads one file. A payload whose
HTTP message is longer than a segment is continued in ``continuation`` records. Reading groups those by the id of
the record that they continue, orders them by segment number, verifies the total length and decodes the chunked
transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, hot_join, in_arrow, new_folder, values, written

MARK = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Bytes of one segment's block, and of one chunk of the transfer framing.
SEGMENT, CHUNK = 32_768, 4_096
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hexadecimal digits are four base32 digits."""
    sha = F.sha1(payload)
    four = [F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: str, record_id: str, block: bytes, **headers: object) -> bytes:
    """One record up to its block's end; the writer's line separator closes it."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return (MARK + "\r\n".join(lines) + END).encode() + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; ValueError if the framing is broken. Chunk extensions are skipped."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size line has no end")
        size = int(framed[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = framed[end + 2 : end + 2 + size]
        if len(part) < size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(part)
        at = end + 4 + size


def segments(kind: str, record_id: str, block: bytes, size: int, **headers: object) -> Iterator[bytes]:
    """A record, or if its block is longer than a segment, the first segment and its continuations."""
    if len(block) <= size:
        yield record(kind, record_id, block, **headers)
        return
    yield record(kind, record_id, block[:size], WARC_Segment_Number=1, **headers)
    starts = range(size, len(block), size)
    for k, at in enumerate(starts, 2):
        total = len(block) if k == len(starts) + 1 else None
        yield record("continuation", f"{record_id}:{k}", block[at : at + size], WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def _named(page: object) -> str:
    """A page's id within a record's id: escaped, after a sign that no null has."""
    return "" if page is None else "=" + quote(str(page), safe="")


def _page(named: str) -> str | None:
    return unquote(named[1:]) if named else None


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to: what each record will be.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a response (and repeated
    rows of it), refers_to is null there; the others revisit it. Rows without page_id are responses. Payloads never
    meet by their content: only digests and ids are grouped, and payloads are dealt by their own id. A payload that a
    large share of the pages has (an empty one) finds its response by broadcast. Ids may be strings with any signs.
    """
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), F.coalesce(col(html_col), F.lit("")).cast("binary").alias("payload"))
    sized = rows.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= min_bytes))
    digests = written(sized.select("page_id", "digest", F.concat_ws(":", "digest", "n").alias("key")), "digests")
    first = digests.groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("rows")).where("first < last")
    again = hot_join(digests, written(first, "repeated-digests"), "key", "rows").where("page_id > first").select("page_id", "digest", "first").distinct()
    return rows.withColumn("digest", base32_sha1(F.col("payload"))).join(again, ["page_id", "digest"], "left").withColumnRenamed("first", "refers_to")


def write_archives(records: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Write the records of ``with_revisits`` as archives under ``path``, one for each partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            out = []
            for page, url, payload, digest, first, task in zip(*map(values, b.columns), strict=True):
                number += 1
                rid = f"urn:x-page:{_named(page)}:{task}-{number}"
                uri = re.sub(r"[\r\n]+", " ", url or "")
                shared = {"WARC_Target_URI": uri or None, "WARC_Payload_Digest": f"sha1:{digest}"}
                if first is None:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                    out += segments("response", rid, head + chunked(payload, chunk), segment, Content_Type="application/http;msgtype=response", **shared)
                else:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    out.append(record("revisit", rid, head, Content_Type="application/http;msgtype=response", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:x-page:{_named(first)}>", **shared))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = records.select("page_id", "url", "payload", "digest", "refers_to", F.spark_partition_id().alias("task"))
    lines = in_arrow(rows, scan, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


_RAW = "id string, type string, page string, refers string, digest string, origin string, number int, total long, block binary"


def _header(raw: bytes) -> tuple[dict[str, str], int, int] | None:
    """A record's fields, where its block begins, and the block's length; None if the header isn't whole yet."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4, int(fields.get("content-length", "0"))


def _record(fields: dict[str, str], block: bytes) -> tuple:
    rid = fields.get("warc-record-id", "").strip("<>")
    number = fields.get("warc-segment-number")
    total = fields.get("warc-segment-total-length")
    origin = fields.get("warc-segment-origin-id", "").strip("<>") or (rid if number else None)
    page = _page(rid.split(":")[2]) if rid.startswith("urn:x-page:") else None
    refers = _page(fields.get("warc-refers-to", "").strip("<>").removeprefix("urn:x-page:"))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return rid, fields.get("warc-type"), page, refers, digest, origin, number and int(number), total and int(total), block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``. A block may hold the records' mark: pieces are put together until it is whole."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []  # of a record that isn't whole yet
        size, head = 0, None
        for b in batches:
            out = []
            for raw in values(b.column(0)):
                if not pieces and not raw.strip():
                    continue
                pieces += [MARK.encode(), raw] if pieces else [raw]
                size += len(raw) + (len(MARK) if len(pieces) > 1 else 0)
                if head is None:
                    pieces = [b"".join(pieces)]
                    head = _header(pieces[0])
                if head is not None and size >= head[1] + head[2]:
                    fields, begin, length = head
                    out.append(_record(fields, b"".join(pieces)[begin : begin + length]))
                    pieces, size, head = [], 0, None
            kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _RAW.split(", ")])
        if pieces:
            raise ValueError("an archive ends within a record")

    lines = spark.read.option("lineSep", MARK).text(path)
    return in_arrow(lines.select(F.col("value").cast("binary").alias("value")), scan, _RAW)


def reassembled(records: DataFrame) -> DataFrame:
    """One row for each whole record: id, type, page, refers, digest, block.

    Segments are grouped by the record that they begin with, put in order, and must be numbered without gaps and
    as long in all as the last one says; if not, the job fails. A group is one record, never more.
    """
    whole = records.where("origin is null").select("id", "type", "page", "refers", "digest", "block")
    parts = F.array_sort(F.collect_list(F.struct("number", "total", "block")))
    grouped = records.where("origin is not null").groupBy("origin").agg(
        parts.alias("parts"),
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "page", "refers", "digest")),
        F.max("total").alias("total"),
    )
    numbers = F.transform("parts", lambda p: p["number"])
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))  # each byte is copied a few times, however many segments there are
    bad = (numbers != F.sequence(F.lit(1), F.size("parts"))) | F.col("total").isNull() | (F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"])) != F.col("total"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("segments are missing or of wrong length: "), F.col("origin"))).cast("binary")).otherwise(joined)
    return whole.unionByName(grouped.select(F.col("origin").alias("id"), "type", "page", "refers", "digest", checked.alias("block")))


def payloads(records: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of whole records.

    Responses give their decoded payload, whose digest must be the one in the header. Revisits carry no payload:
    the length comes from their HTTP header, the digest from their WARC header.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, page, refers, digest, block in zip(*(values(b.column(i)) for i in range(5)), strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                head = head.lower()
                if kind == "revisit":
                    length = int(re.search(rb"\r\ncontent-length:\s*(\d+)", head)[1])
                    out.append((page, None, length, digest, kind, refers))
                else:
                    payload = unchunked(body) if re.search(rb"\r\ntransfer-encoding:\s*chunked", head) else body
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest not in (None, found):
                        raise ValueError(f"the payload of page {page} isn't what its digest says")
                    out.append((page, payload, len(payload), found, kind, None))
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["page", "payload", "payload_bytes", "payload_digest", "record_type", "refers"])

    made = in_arrow(records.select("type", "page", "refers", "digest", "block"), scan, "page string, payload binary, payload_bytes long, payload_digest string, record_type string, refers string")
    return made.select(F.col("page").cast(id_type).alias("page_id"), "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def archive_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """Write a record for each row of ``pages`` under ``path`` and return what reading the archives gives (see ``payloads``).

    Null html is an empty payload. Cases of equal payloads, ties and null ids as in ``with_revisits``. An empty
    table gives no rows; other columns are ignored.
    """
    path = path or new_folder(pages.sparkSession, "warc")
    rows = with_revisits(pages, id_col, url_col, html_col, min_bytes)
    write_archives(rows, path, segment, chunk)
    return payloads(reassembled(read_records(pages.sparkSession, path)), rows.schema["page_id"].dataType.simpleString())
