"""WARC: reading records, and resolving not-modified revisits.

A revisit of a server that answered 304 has no body. It is resolved by an as-of join on the canonical URL to
the latest earlier full response; its validators must agree with that response, and the headers that a 304
may update are laid over the response's own.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Headers that a 304 response may update (RFC 9110, 15.4.5), and parameters that name no content.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
RECORD = "file string, position long, type string, uri string, date string, record_id string, fields map<string,string>, status int, headers map<string,string>, payload binary"


def _header_block(data: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:  # a folded line goes on with the value before
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return first, out, rest


def _plain(data: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a file, or of each of its gzip members; after a broken member the next one is looked for."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        member, out, stop = zlib.decompressobj(31), [], at
        try:
            while stop < len(data) and not member.eof:
                out.append(member.decompress(view[stop : stop + piece]))
                stop = min(stop + piece, len(data))
        except zlib.error:
            pass
        if member.eof:
            yield b"".join(out)
            at = stop - len(member.unused_data)
            if data[at : at + 2] == b"\x1f\x8b":
                continue
        at = data.find(b"\x1f\x8b\x08", at + (not member.eof))


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped by record or not; a broken record is left out, and those behind it are not."""
    before = 0
    for plain in _plain(data):
        at = 0
        while (start := plain.find(b"WARC/", at)) >= 0:
            end = plain.find(b"\r\n\r\n", start)
            fields = _header_block(plain[start : end + 4])[1] if end >= 0 else {}
            size = fields.get("content-length", "")
            after = end + 4 + int(size) if size.isdigit() else -1
            if not (0 <= after <= len(plain)):
                at = start + 5
                continue
            block = plain[end + 4 : after]
            row = {"position": before + start, "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "record_id": fields.get("warc-record-id"), "fields": fields, "status": None, "headers": {}, "payload": block}
            if fields.get("content-type", "").startswith("application/http") and block.startswith(b"HTTP/"):
                line, headers, body = _header_block(block)
                code = line.split(" ")[1:2]
                row |= {"status": int(code[0]) if code and code[0].isdigit() else None, "headers": headers, "payload": body}
            yield row
            at = after
        before += len(plain)


def format_warc(kind: str, uri: str, date: str, record_id: str, status: int, headers: dict[str, str], payload: bytes, packed: bool = True) -> bytes:
    """One record as parse_warc() reads it."""
    http = f"HTTP/1.1 {status} -\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nWARC-Record-ID: {record_id}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    record = head + http + b"\r\n\r\n"
    return gzip.compress(record, mtime=0) if packed else record


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files under ``path``; a file is one task's work, and must fit in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [{"file": name, **r} for r in parse_warc(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"status": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD)


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or m., no scheme, default port, fragment, tracking parameter or closing slash."""
    trimmed = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(trimmed, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(www|m)\.|:(80|443)$", "")
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    query = F.regexp_extract(tail, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    path = F.regexp_replace(F.regexp_replace(tail, r"\?.*$", ""), r"/+$", "")
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def latest_before(events: DataFrame, key: str, order: list[str], full: str, partitions: int | None = None) -> DataFrame:
    """``events`` with _found: the order columns of the latest earlier row of the same key for which ``full`` holds.

    Rows are laid out in ranges of (key, order); windows run within a key's part of a range, and each part
    begins with what the parts before it have found. So a key that holds most rows is spread over ranges.
    """
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(events.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()))
    at = F.struct(*order)
    within = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = laid.withColumn("_here", F.last(F.when(F.col(full), at), ignorenulls=True).over(within))
    parts = laid.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.max(F.when(F.col(full), at)).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_k", "_p", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = here.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    return joined.withColumn("_found", F.coalesce("_here", "_carried")).drop("_part", "_here", "_k", "_p", "_carried")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url, date, outcome, response_id, headers, payload) for every revisit with status 304.

    ``records`` has record_id (orders equal dates), type, uri, date, status, headers and payload. Full
    responses are those of type response and status 200. A revisit without one before it is "missing"; where
    both name an ETag, or else both a Last-Modified, these must agree ("mismatch" otherwise), and without a
    validator on either side it is "unchecked". Only resolved and unchecked rows get headers and a payload. Records
    without a URL or date are no responses; revisits without are missing. Other record types are ignored, and so
    are other columns. Of rows of one record_id the one of least date, then of least URL or hash of its payload, stands.
    """
    based = records.withColumn("url", canonical_url(F.col("uri")))
    full = (F.col("type") == "response") & (F.col("status") == 200)
    revisit = (F.col("type") == "revisit") & (F.col("status") == 304)
    events = based.filter(full | revisit).select("record_id", "url", "date", F.coalesce(full & F.col("url").isNotNull() & F.col("date").isNotNull(), F.lit(False)).alias("full"))
    found = latest_before(events, "url", ["date", "record_id"], "full").filter(~F.col("full")).select("record_id", F.struct("date", "url").alias("at"), F.when(F.col("date").isNotNull() & F.col("url").isNotNull(), F.col("_found.record_id")).alias("response_id"))
    found = found.groupBy("record_id").agg(F.min_by("response_id", "at").alias("response_id"))
    asked = based.filter(revisit).select("record_id", "url", "date", F.col("headers").alias("new")).groupBy("record_id").agg(F.min_by(F.struct("url", "date", "new"), F.struct("date", "url")).alias("r")).select("record_id", "r.*")
    answers = based.filter(full).select(F.col("record_id").alias("response_id"), F.struct(F.col("headers").alias("old"), "payload").alias("a"), F.struct("date", F.xxhash64("payload")).alias("at"))
    answers = answers.groupBy("response_id").agg(F.min_by("a", "at").alias("a")).select("response_id", "a.*")
    both = asked.join(found, "record_id").join(answers, "response_id", "left")

    def agree(name: str) -> Column:
        return F.col("old")[name] == F.col("new")[name]

    verdict = F.coalesce(agree("etag"), agree("last-modified"))
    outcome = F.when(F.col("response_id").isNull(), "missing").when(verdict.isNull(), "unchecked").when(verdict, "resolved").otherwise("mismatch")
    update = F.map_filter("new", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    usable = F.col("outcome").isin("resolved", "unchecked")
    return both.withColumn("outcome", outcome).select("record_id", "url", "date", "outcome", "response_id", F.when(usable, merged).alias("headers"), F.when(usable, F.col("payload")).alias("payload"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two crawls of every page as records: the page in full, and three days later a 304 for the same URL.

    Pages are crawled a minute apart, in the order of page_id. The revisit's ETag is that of the page, so it
    disagrees where another page has been crawled at the same canonical URL in between.
    """
    begin = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("page_id"))
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    old = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("etag"), etag, F.lit("cache-control"), F.lit("max-age=60"))
    new = F.create_map(F.lit("etag"), etag, F.lit("cache-control"), F.lit("max-age=3600"), F.lit("content-length"), F.lit("0"), F.lit("set-cookie"), F.lit("visit=2"))
    first = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("type"), F.col("url").alias("uri"), begin.alias("date"), F.lit(200).alias("status"), old.alias("headers"), F.col("html").cast("binary").alias("payload"))
    second = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), F.col("url").alias("uri"), (begin + F.expr("INTERVAL 3 DAYS")).alias("date"), F.lit(304).alias("status"), new.alias("headers"), F.lit(None).cast("binary").alias("payload"))
    return first.unionByName(second)


def digest(resolved: DataFrame) -> DataFrame:
    """Plain columns of resolve(): the headers as sorted lines, the payload as an MD5."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return resolved.select(F.expr("record_id div 2").alias("page_id"), "url", F.unix_seconds("date").alias("revisit_time"), "outcome", F.expr("response_id div 2").alias("response_page_id"), lines.alias("headers"), F.md5("payload").alias("payload_md5"))


ORACLE = r"""
WITH parts AS (
    SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages
), cut AS (
    SELECT page_id, html, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(www|m)\.|:(80|443)$', '', 'g') AS host,
        regexp_replace(rest, '^[^/?]*', '') AS tail FROM parts
), kept AS (
    SELECT page_id, html, host, regexp_replace(regexp_replace(tail, '\?.*$', ''), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(tail, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS query FROM cut
), named AS (
    SELECT page_id, html, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url,
        '"' || md5(coalesce(html, '')) || '"' AS etag, 1704067200 + 60 * page_id AS at FROM kept
), found AS (
    SELECT r.page_id, r.url, r.at + 259200 AS revisit_time, r.etag, f.page_id AS response_page_id, f.etag AS old_etag, f.html
    FROM named r ASOF LEFT JOIN named f ON r.url = f.url AND r.at + 259200 >= f.at
)
SELECT page_id, url, revisit_time, CASE WHEN response_page_id IS NULL THEN 'missing' WHEN etag = old_etag THEN 'resolved' ELSE 'mismatch' END AS outcome, response_page_id,
    CASE WHEN etag = old_etag THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || coalesce(strlen(html), 0) || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag END AS headers,
    CASE WHEN etag = old_etag THEN md5(html) END AS payload_md5
FROM found
"""
