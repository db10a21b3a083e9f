"""WARC archives: writing page captures and assembling transactions from what is read back.

Writing gives each capture three records that name each other by WARC-Concurrent-To: the response (or, for a payload
that is kept elsewhere, a revisit), the request and metadata.  Of captures with equal payloads of at least MIN_REVISIT
bytes that with the largest page id holds the payload and the others revisit it.  Archives are plain WARC/1.1 files
written by Spark's text writer, so they lie in whatever store the path names.

Reading splits archives at the record boundary, in parallel within large files too, checks every record's
Content-Length, puts records together again that a payload with that boundary in it had cut, and joins request,
response and metadata through concurrent-to identifiers into one nested row per capture.

Defined results: a null payload is empty; null ids are written empty and read as null; of equal payloads under one page
id that with the largest url responds; records that belong to no capture are nested with a null capture; an empty table gives an archive without records.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import written

#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 1000
VERSION = "WARC/1.1"
#: Payloads kept more than once of which so many at most are broadcast (about 20 MB); more are joined by a shuffle.
BROADCAST_HOLDERS = 150_000
#: Archives are split at this mark, of version 1.0 and 1.1 alike; no part of it begins it anew, so it can't be missed.
_MARK = "WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\0", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the version line and the closing blank lines."""
    head = [x for k, v in fields for x in (F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")),)]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def plan_captures(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """key, url, payload, payload_bytes, payload_digest, record_id and refers_id (null: the capture holds its payload)."""
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    p = p.withColumn("record_id", _urn(F.lit("capture"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "payload_digest"))
    holder = p.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "record_id")).alias("h"), F.count("*").alias("n"))
    holder = written(holder.filter("n > 1").select("payload_digest", F.col("h.record_id").alias("holder_id")), "holders")
    holder = F.broadcast(holder) if holder.count() <= BROADCAST_HOLDERS else holder.hint("merge")
    return p.join(holder, "payload_digest", "left").withColumn("refers_id", F.when(F.col("holder_id") != F.col("record_id"), F.col("holder_id"))).drop("holder_id")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", captured: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the captures of pages as WARC files under path."""
    c = plan_captures(pages, key, payload, url)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    host = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("localhost"))
    route = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    clean = F.regexp_replace("url", r"[\x00-\x20]", "")
    date, rid = F.lit(captured), F.col("record_id")
    http = line("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("payload_bytes").cast("string"), "\r\n\r\n")
    revisit = F.col("refers_id").isNotNull()
    answer = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", clean),
            ("WARC-Payload-Digest", line("sha1:", F.col("payload_digest"))), ("WARC-Refers-To", F.col("refers_id")), ("WARC-Profile", F.when(revisit, _PROFILE)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, "payload")),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), rid)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request"))],
        line("GET ", F.regexp_replace(route, r"[\x00-\x20]", ""), " HTTP/1.1\r\nHost: ", F.regexp_replace(host, r"[\x00-\x20]", ""), "\r\n\r\n"),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), rid)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))],
        line("page-id: ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "\r\n"),
    )
    end = "\r\n\r\n"
    # The text writer ends each row with the last byte of the closing blank lines.
    whole = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (f"{VERSION}\r\n", request, end, f"{VERSION}\r\n", answer, end, f"{VERSION}\r\n", metadata, "\r\n\r")])
    c.select(whole.alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("head"), rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _framed(pieces: DataFrame) -> DataFrame:
    """pieces with head (first line: the rest of the version), length (its Content-Length) and fits (bytes are as many)."""
    p = pieces.withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    p = p.withColumn("length", F.expr("try_cast(nullif(regexp_extract(head, '(?i)\\r\\nContent-Length:[ \\t]*([0-9]+)', 1), '') AS bigint)"))
    room = F.octet_length("value") - F.octet_length("head") - 4
    return p.withColumn("fits", F.coalesce((room == F.col("length") + 4) | (room == F.col("length")), F.lit(False)))


def _mended(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one archive in order, as whole records: pieces join until a record has its Content-Length."""
    import re

    out, held = [], b""
    for raw in pdf.sort_values(["start", "seq"])["raw"]:
        held = held + _MARK.encode() + raw if held else raw
        head, _, block = held.partition(b"\r\n\r\n")
        m = re.search(rb"(?i)\r\nContent-Length:[ \t]*([0-9]+)", head)
        if not held or m and len(block) >= int(m[1]):
            out.append(held)
            held = b""
    return pd.DataFrame({"raw": pd.Series([x for x in [*out, held] if x], dtype=object)})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: type, record_id, concurrent_to (all, in order), refers_to, uri, date, digest, block (bytes), complete.

    Archives are split at the version mark; a piece that isn't as long as its record says was cut at a mark inside a
    payload, and the archives that hold such pieces are read in order.
    """
    text = spark.read.option("lineSep", _MARK).text(path).filter("value != ''")
    pieces = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    p = _framed(pieces)
    torn = [r["file"] for r in p.filter("NOT fits").select("file").distinct().toLocalIterator()]  # names of files only
    whole = p.select("value", "head", "length", "fits")
    if torn:
        again = pieces.filter(F.col("file").isin(torn)).withColumn("seq", F.monotonically_increasing_id()).select("file", "start", "seq", F.col("value").cast("binary").alias("raw"))
        mended = again.groupBy("file").applyInPandas(_mended, "raw binary").select(F.col("raw").cast("string").alias("value"))
        whole = p.filter(~F.col("file").isin(torn)).select("value", "head", "length", "fits").unionByName(_framed(mended))
    return whole.select(
        _field("WARC-Type").alias("type"),
        _field("WARC-Record-ID").alias("record_id"),
        F.regexp_extract_all("head", F.lit(r"(?i)(?:^|\r\n)WARC-Concurrent-To:[ \t]*([^\r\n]*)"), 1).alias("concurrent_to"),
        _field("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Date").alias("date"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "(?i)^sha1:", "").alias("digest"),
        F.expr("substring(CAST(value AS BINARY), octet_length(head) + 5, CAST(coalesce(length, 0) AS INT))").alias("block"),
        F.col("fits").alias("complete"),
    )


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, response, requests[], metadata[].

    Request and metadata records name their capture by concurrent-to; those that don't are looked up among the ids that
    captures name themselves.  Without payloads only their digests and sizes are shuffled.
    """
    captures = records.filter(F.col("type").isin("response", "revisit"))
    rest = records.filter(F.col("type").isin("request", "metadata"))
    side = rest.withColumn("capture_id", F.get("concurrent_to", F.lit(0)))
    if not rest.filter(F.size("concurrent_to") == 0).isEmpty():
        back = captures.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id")).distinct()
        unnamed = side.filter("capture_id IS NULL").drop("capture_id").join(back, "record_id", "left")
        side = side.filter("capture_id IS NOT NULL").unionByName(unnamed)
    item = F.struct("record_id", "date", "uri", F.col("block").cast("string").alias("block"))
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, item)))
    side = side.withColumn("capture_id", F.coalesce("capture_id", "record_id")).groupBy("capture_id").agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    full = F.col("type") == "response"
    body = F.expr("substring(block, octet_length(http_head) + 5)")
    sized = F.expr("try_cast(nullif(regexp_extract(http_head, '(?i)\\r\\nContent-Length:[ \\t]*([0-9]+)', 1), '') AS bigint)")
    answer = captures.withColumn("http_head", F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)).select(
        F.col("record_id").alias("capture_id"),
        F.struct(
            "record_id", "type", "uri", "date", "refers_to", F.col("digest").alias("payload_digest"), "http_head",
            *[F.when(full, body.cast("string")).alias("payload")] * payloads,
            F.when(full, F.sha1(body)).otherwise(F.col("digest")).alias("read_digest"),
            F.when(full, F.octet_length(body).cast("long")).otherwise(sized).alias("payload_bytes"),
            "complete",
        ).alias("response"),
    )
    return answer.join(side, "capture_id", "full_outer")


def page_rows(assembled: DataFrame) -> DataFrame:
    """Per capture with a page id in its metadata: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    page = F.expr("try_cast(nullif(regexp_extract(get(metadata, 0).block, '(?i)page-id:[ \\t]*([-0-9]*)', 1), '') AS bigint)")
    return assembled.filter(F.col("response").isNotNull()).select(
        page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.read_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("capture_id"), F.col("response.refers_to").alias("refers_id"),
    )


def round_trip(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Writes pages to an archive at path, reads it back and returns a row per page; refers_to is the responding page's id."""
    write_archive(pages, path, key, payload, url)
    rows = written(page_rows(assemble(read_records(pages.sparkSession, path), payloads=False)), "captures")
    first = rows.filter("refers_id IS NULL").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_id"])
    return rows.join(first, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
