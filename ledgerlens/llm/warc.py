"""WARC archives: writing pages as request, response and metadata records, and assembling
the transactions again through their concurrent-to identifiers.

Writing keeps to Spark's own writer: a row of the text sink is one transaction, and the
sink's line separator is the blank lines that end a record, so files are plain WARC/1.1
and are committed as Spark commits files. Reading takes whole files as binary rows (the
writer bounds their records), walks them by Content-Length, and joins the parts.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CRLF = "\r\n"
#: Transactions and, unless one alone has more, bytes of payload in a file at most; a file is read as one row.
FILE_ROWS = 2048
FILE_BYTES = 1 << 28
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 160 bits are 8 groups of 5 hex digits or 4 letters."""
    digest = F.sha1(data)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.lit(_BASE32).substr((F.shiftright(bits, 15 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(4)]
    return F.concat(*letters)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers]  # a null value leaves its line out
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, scratch: Scratch | None = None, compression: str = "none") -> None:
    """Writes a transaction for each row of pages(page_id, url, html).

    Of rows with equal payloads of at least min_revisit_bytes the one with the least page_id
    is a response (every row that repeats this page_id is one as well), and others revisit
    it; shorter payloads are responses. A null html is an empty payload; a null url leaves
    out the target; line breaks in a url become blanks; a null page_id is its own least; rows
    that repeat are records of their own; an empty table gives an empty archive; other columns
    are ignored. Rows are named by their places in ``pages``, which must come in the same order
    whenever they are read, as those of a table do.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), "[\\r\\n]", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("seq", F.monotonically_increasing_id())
    firsts = rows.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.min(F.struct(F.coalesce("page_id", F.lit(-(1 << 62))).alias("p"), "page_id", "url", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = scratch.save(firsts.select(F.col("digest").alias("_digest"), "first"), "firsts")
    # no hint: the planner knows the size of the written table
    met = rows.join(firsts, rows.digest == firsts._digest, "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    ident = lambda kind, page, seq: _uuid(F.lit(kind), page.cast("string"), seq.cast("string"))
    main = ident("main", F.col("page_id"), F.col("seq"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))]
    no = F.lit(None).cast("string")
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", main),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(revisit, ident("main", F.col("first.page_id"), F.col("first.seq"))).otherwise(no)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", ident("request", F.col("page_id"), F.col("seq"))), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", ident("metadata", F.col("page_id"), F.col("seq"))), *common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF))),
    )
    text = F.concat_ws(CRLF * 2, request, response, metadata)
    # payloads of more than a file's share go to files with fewer records
    longest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    share, most = FILE_BYTES // FILE_ROWS, FILE_ROWS
    least = -1
    while True:
        last = longest <= share
        some = met.filter(F.octet_length("html") > least) if last else met.filter(F.octet_length("html").between(least + 1, share))
        writer = some.select(text.alias("value")).write.mode("append").option("lineSep", CRLF * 2)
        writer.option("maxRecordsPerFile", most).option("compression", compression).text(path)
        if last:
            return
        least, share, most = share, share * 16, max(1, most // 16)


def parse_warc(data: memoryview | bytes):
    """Yields (headers, block) for each record; names of headers in lower case."""
    data = memoryview(data)
    raw = data.obj if isinstance(data.obj, bytes) and len(data.obj) == len(data) else bytes(data)
    at, end = 0, len(raw)
    while at < end:
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError(f"a WARC record has no end of headers at byte {at}")
        lines = raw[at:stop].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = stop + 4
        n = int(headers["content-length"])
        if at + n > end:
            raise ValueError(f"a WARC record is cut off at byte {at}")
        yield headers, data[at : at + n]
        at += n
        while at < end and raw[at] in b"\r\n":
            at += 1


_RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, named_digest string, payload_digest string, payload_bytes long, fields map<string,string>"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all files under path; digest and length are those of the bytes read.

    An archive without files or records gives no rows; one that is cut off is an error.
    """

    def work(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse_warc(content.as_buffer()):
                    kind = h.get("warc-type")
                    body, fields = None, []
                    if kind == "response":
                        raw = bytes(block)
                        body = raw[raw.find(b"\r\n\r\n") + 4 :]
                    elif kind == "metadata":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in bytes(block).decode("utf-8").split(CRLF) if x)]
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if body is not None else None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), digest, None if body is None else len(body), fields, *([body] if with_payload else [])))
                    if len(rows) == 1000:
                        yield _batch(rows, with_payload)
                        rows = []
                if rows:
                    yield _batch(rows, with_payload)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, _RECORD + ", payload binary" * with_payload)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * with_payload
    names = [c.split()[0] for c in _RECORD.replace("map<string,string>", "map").split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, record_type, response, request, metadata).

    Requests and metadata are joined to the response or revisit that they are concurrent to;
    where one is missing its struct is null, and those of no capture are left out. A revisit
    carries in ``original`` the response that it refers to, null where that is not among the
    records. Null identifiers meet nothing; a record that comes twice gives its capture twice;
    no records give no rows.
    """
    part = lambda kind: records.filter(F.col("record_type") == kind).select(F.col("concurrent_to").alias("_to"), F.struct("record_id", "target_uri", "fields").alias(kind))
    extra = ["payload"] if "payload" in records.columns else []
    main = records.filter(F.col("record_type").isin("response", "revisit"))
    main = main.select("record_id", "record_type", "refers_to", F.struct("target_uri", "named_digest", "payload_digest", "payload_bytes", *extra).alias("response"))
    out = main
    for kind in ("request", "metadata"):
        p = part(kind)
        out = out.join(p, out.record_id == p._to, "left").drop("_to")
    page = F.col("metadata.fields")["page-id"].cast("long")
    out = out.withColumn("page_id", page)
    first = out.filter("record_type = 'response'").select(F.col("record_id").alias("_ref"), F.struct("page_id", "response.payload_digest", "response.payload_bytes").alias("original"))
    return out.join(first, out.refers_to == first._ref, "left").drop("_ref")


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Nested captures of pages written to archives in the shared folder and read back."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    write_warc(pages, path, min_revisit_bytes, scratch)
    records = scratch.save(read_records(pages.sparkSession, path), "records")
    return assemble(records)


def oracle() -> str:
    letters = " || ".join(f"substr('{_BASE32}', cast(((cast('0x' || substr(h, {5 * g + 1}, 5) as bigint) >> {15 - 5 * i}) & 31) + 1 as bigint), 1)" for g in range(8) for i in range(4))
    return f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
q as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {letters} as payload_digest, min(page_id) over (partition by h) as first_id from p)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from q
"""
