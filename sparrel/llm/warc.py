"""WARC records: reading and writing them, and resolving not-modified revisits.

A revisit of profile server-not-modified has no payload: it stands for the latest earlier
full response to the same canonical URL. Resolution is an as-of join: records are range-sorted
by (URL, time, id) into chunks, so that a URL that holds a third of all records spans many;
in a chunk a window carries the last response on, and of chunks before only their last
response for the URL is looked up. Then validators decide, and headers are merged.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrel.llm.scratch import materialize

#: Headers of a 304 answer that replace the stored ones (fixed values of the HTTP standard).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query fields that do not change what a URL names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without index page and last slash, other fields sorted; no scheme, no fragment."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(whole, PREFIX + "([^/?]*)", 1)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(whole, PREFIX + r"[^/?]*([^?]*)", 1), r"/(index\.html?)?$", "")
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&", -1), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Add canonical_url, refers_to, outcome, payload_digest and headers as resolved, to each record.

    records: record_id, url, captured (any type that sorts), kind (response or revisit), status,
    headers (map, names in lower case), payload_digest; other columns are dropped. Earlier is
    by captured, then record_id. outcome: 'full' for anything but a revisit; 'resolved' where the
    latest earlier response with status 200 agrees in ETag (weakly compared), or, if either has no
    ETag, in Last-Modified; 'stale' where these differ, 'unvalidated' where there is nothing to
    compare, 'missing' without such a response, or without URL or time. Only resolved revisits get the
    digest and headers of the response, with the permitted headers of their own over them. Repeated records resolve alike.
    """
    spark = records.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    full = known & (F.col("kind") == "response") & (F.col("status") == 200)
    response = F.when(full, F.struct("record_id", "payload_digest", "headers")).alias("response")
    named = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured", "kind", "status", "headers", "payload_digest").select("*", response)
    order = ["canonical_url", "captured", "record_id"]
    chunks = materialize(named.repartitionByRange(partitions, *order).withColumn("chunk", F.spark_partition_id()), "captures")

    within = Window.partitionBy("chunk", "canonical_url").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    last = chunks.where("response is not null").groupBy("canonical_url", "chunk").agg(F.max_by("response", F.struct("captured", "record_id")).alias("own"))
    every = chunks.select("canonical_url", "chunk").distinct().join(last, ["canonical_url", "chunk"], "left")
    across = Window.partitionBy("canonical_url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("canonical_url", "chunk", F.last("own", ignorenulls=True).over(across).alias("carried")).where("carried is not null")

    seen = chunks.withColumn("near", F.last("response", ignorenulls=True).over(within)).join(carried, ["canonical_url", "chunk"], "left")
    found = F.coalesce("near", "carried")
    revisit = F.col("kind") == "revisit"
    mine, theirs = F.col("headers"), F.col("found.headers")
    etags = mine["etag"].isNotNull() & theirs["etag"].isNotNull()
    dates = mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull()
    agrees = F.when(etags, _strong(mine["etag"]) == _strong(theirs["etag"])).when(dates, mine["last-modified"] == theirs["last-modified"])
    outcome = (
        F.when(~F.coalesce(revisit, F.lit(False)), "full")
        .when(F.col("found").isNull() | ~known, "missing")
        .when(agrees.isNull(), "unvalidated")
        .when(agrees, "resolved")
        .otherwise("stale")
    )
    solved = F.col("outcome") == "resolved"
    over = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    return (
        seen.withColumn("found", found)
        .withColumn("outcome", outcome)
        .select(
            "record_id",
            "canonical_url",
            "captured",
            "kind",
            F.when(solved, F.col("found.record_id")).alias("refers_to"),
            "outcome",
            F.when(solved, F.col("found.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
            F.when(solved, F.map_concat(kept, over)).otherwise(F.col("headers")).alias("headers"),
        )
    )


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl's records of each page: its URL and its host's front page, each captured, and asked for again later.

    Pages are captured in an order mixed by their number, and asked for again hours later, so captures of
    a front page lie between others of it; it has four versions, and every sixth capture of it failed. Answers of some pages have
    another ETag, or none and are told by date, or neither.
    """
    page, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    front = F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1), F.lit("/"))
    short = F.substring(html, 1, 200)
    at = F.pmod(page * 7919, F.lit(10_007))
    etag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.pmod(page, F.lit(365)).cast("string"))
    version = F.concat(F.lit('"v'), F.pmod(page, F.lit(4)).cast("string"), F.lit('"'))
    nothing = F.lit(None).cast("string")

    def moment(second: Column) -> Column:
        return F.format_string("2024-01-%02dT%02d:%02d:%02dZ", 1 + F.floor(second / 86400), F.floor(second / 3600) % 24, F.floor(second / 60) % 60, second % 60)

    def record(shift: int, url: Column, second: Column, kind: str, status: Column, payload: Column | None, tag: Column, changed: Column) -> Column:
        told = [("cache-control", F.lit("max-age=60")), ("content-length", F.lit("0"))]
        if payload is not None:
            told = [("content-type", F.lit("text/html")), ("content-length", F.octet_length(payload).cast("string"))]
        told += [("etag", tag), ("last-modified", changed), ("date", moment(second))]
        headers = F.map_filter(F.create_map(*[x for k, v in told for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
        body = F.encode(payload, "utf-8") if payload is not None else F.lit(b"")
        digest = F.concat(F.lit("md5:"), F.md5(payload)) if payload is not None else nothing
        names = {"record_id": page * 4 + shift, "url": url, "captured": moment(second), "kind": F.lit(kind), "status": status, "headers": headers, "payload_digest": digest, "payload": body}
        return F.struct(*(v.alias(k) for k, v in names.items()))

    tag = F.when(page % 5 == 0, F.lit('"other"')).when((page % 7 == 0) | (page % 11 == 0), nothing).otherwise(F.concat(F.lit("W/"), etag))
    made = F.array(
        record(0, F.col("url"), at, "response", F.lit(200), html, etag, day),
        record(1, F.col("url"), at + 1 + F.pmod(page * 31, F.lit(5000)), "revisit", F.lit(304), None, tag, F.when(page % 11 != 0, day)),
        record(2, front, at + 7, "response", F.when(page % 6 == 0, 503).otherwise(200), short, version, nothing),
        record(3, front, at + 7 + F.pmod(page * 13, F.lit(10_007)), "revisit", F.lit(304), None, F.concat(F.lit("W/"), version), nothing),
    )
    return pages.select(F.explode(made).alias("r")).select("r.*")


def revisit_digest(pages: DataFrame) -> DataFrame:
    """What became of each record of ``captures_of_pages``, written as archives and read back; refers_to is -1 where there is none."""
    read = read_warc(write_warc(captures_of_pages(pages), level=0)).drop("payload")
    # written, as the range sort reads its input twice
    made = resolve_revisits(materialize(read.withColumn("record_id", F.regexp_extract("warc_id", r"(-?\d+)>$", 1).cast("long")), "records"))
    return made.select("record_id", "canonical_url", "kind", F.coalesce("refers_to", F.lit(-1).cast("long")).alias("refers_to"), "outcome", "payload_digest", header_lines(F.col("headers")).alias("headers"))


RECORD = "record_id long, warc_id string, url string, captured string, kind string, status int, headers map<string,string>, payload_digest string, payload binary, problem string"
#: Bytes of an archive that ``write_warc`` makes, and records that ``read_warc`` passes on at once.
ARCHIVE_BYTES, ROWS = 8 << 20, 256


def write_record(kind: str, url: str | None, captured: str, headers: dict[str, str], status: int, payload: bytes = b"", digest: str | None = None, warc_id: str | None = None) -> bytes:
    """One WARC/1.1 record around an HTTP answer."""
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    body = http.encode() + payload
    told = {"WARC-Type": kind, "WARC-Record-ID": warc_id, "WARC-Target-URI": url, "WARC-Date": captured, "WARC-Payload-Digest": digest}
    if kind == "revisit":
        told["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in told.items() if v is not None), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warc(records: DataFrame, level: int = 1) -> DataFrame:
    """(path, content): archives of records (record_id, url, captured, kind, status, headers, payload_digest, payload), a gzip member each.

    level: of compression, 0 where archives are not kept. record_id becomes the end of WARC-Record-ID; a null URL, date or digest is left out.
    """

    def run(batches):
        members, size, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part}-{number}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], ["path", "content"])

        for b in batches:
            for i, url, at, kind, status, headers, digest, payload in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                members.append(gzip.compress(write_record(kind, url, at, dict(headers or ()), status, payload or b"", digest, f"<urn:sparrel:{i}>"), level, mtime=0))
                size += len(members[-1])
                if size > ARCHIVE_BYTES:
                    yield out()
                    members, size, number = [], 0, number + 1
        if members:
            yield out()

    return records.select("record_id", "url", "captured", "kind", "status", "headers", "payload_digest", "payload").mapInArrow(run, "path string, content binary")


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in block.split(b"\r\n") if line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _plain_records(data: bytes) -> Iterator[tuple]:
    """(warc_id, url, date, kind, status, headers, digest, payload, problem) of response and revisit records.

    What can't be read is a record of kind 'damaged' that says why; reading goes on where the next record begins.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head, _, rest = data[at : max(end, at)].partition(b"\r\n")
        named = _fields(rest) if end >= 0 and head.startswith(b"WARC/") else {}
        told = named.get("content-length", "")
        size = int(told) if told.isascii() and told.isdigit() else -1
        body = data[end + 4 : end + 4 + size] if size >= 0 else b""
        if size < 0 or len(body) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            yield named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date"), DAMAGED, None, {}, None, None, f"no whole record at byte {at}"
            following = data.find(b"WARC/1.", at + 1)
            at = following if following >= 0 else len(data)
            continue
        at = end + 8 + size
        if named.get("warc-type") in ("response", "revisit"):
            http, _, payload = body.partition(b"\r\n\r\n")
            status, _, lines = http.partition(b"\r\n")
            code = status.split()[1:2]
            yield named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date"), named["warc-type"], int(code[0]) if code and code[0].isdigit() else None, _fields(lines), named.get("warc-payload-digest"), payload, None


GZIP = b"\x1f\x8b\x08"
#: Bytes of an archive that are inflated at once.
PIECE = 16 << 10
DAMAGED = "damaged"


def read_records(data: bytes) -> Iterator[tuple]:
    """The same of an archive that may be compressed, as archives come: a gzip member at a time."""
    if data[:3] != GZIP:
        yield from _plain_records(data)
        return
    at = 0
    while at < len(data):
        member, parts, end, problem = zlib.decompressobj(wbits=31), [], at, None
        try:
            while not member.eof and end < len(data):  # by pieces: what is left of one behind the member's end is copied
                parts.append(member.decompress(data[end : end + PIECE]))
                end = min(end + PIECE, len(data))
            problem = None if member.eof else "gzip member is cut off"
        except zlib.error as e:
            problem = str(e)
        if problem is None:
            yield from _plain_records(b"".join(parts))
            at = end - len(member.unused_data)
        else:
            yield None, None, None, DAMAGED, None, {}, None, None, f"at byte {at}: {problem}"
            following = data.find(GZIP, at + 1)
            at = following if following >= 0 else len(data)


def read_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files, plain or gzip, one per row as Spark's binaryFile source gives them (path, content).

    record_id: file hash and place. A damaged record is a row of kind 'damaged' whose ``problem`` says why, and the others of its file are
    read. A file is held by one task, so archives should be cut well below an executor's memory (and below 2 GB, a row's limit).
    """
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(), pa.string()]

    def run(batches):
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = read_records(content or b"")
                at = 0
                while rows := list(islice(found, ROWS)):
                    made = [(key + at + k, i, u, d, kind, s, list(h.items()), *rest) for k, (i, u, d, kind, s, h, *rest) in enumerate(rows)]
                    at += len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], [f.split()[0] for f in RECORD.split(", ")])

    return files.select((F.shiftright(F.xxhash64("path"), 24) * F.lit(1 << 24)).alias("key"), "content").mapInArrow(run, RECORD)
