"""WARC archives with revisit records in place of repeated payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.scale import (
    attach_by_key, bound_batches, filter_bits, may_repeat, repeat_filter, scratch_path, scratch_table,
)

#: Records in one archive at most. Archives are streamed: this bounds what a lost task repeats, not memory.
RECORDS = 1_000
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of bytes: four groups of 40 bits, eight digits each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def resolve_revisits(
    df: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, url_col: str | None = "url"
) -> DataFrame:
    """Add ``payload_bytes, payload_digest, record_type, refers_to, refers_to_url`` to the rows of ``df``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the
    response; the others revisit it and name its id and its address (``url_col``, null without one). Headers
    (digest, id, address) are what is grouped: a Bloom filter of digests that occur twice lets all other rows
    pass without a shuffle, and groups of any size are pre-aggregated and attached without skew. Equal means
    equal SHA-256.

    Defined results: a null payload is empty; rows that repeat the smallest id of a payload are all responses
    (their least address is the one named); rows that repeat an id with other payloads are judged by payload;
    null ids never are originals unless the whole group has none, and then all are responses; payloads of any
    length are digested whole; an empty table gives an empty table; other columns pass through, clashing names
    are replaced.
    """
    added = ["payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_url"]
    data = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = df.drop(*added).withColumns({"payload_bytes": F.octet_length(data).cast("long"), "__key": F.sha2(data, 256)})
    rows = rows.withColumn("__h", F.when(F.col("payload_bytes") >= least_bytes, F.conv(F.substring("__key", 1, 16), 16, -10).cast("long")))
    url = F.col(url_col) if url_col else F.lit(None)
    heads = scratch_table(rows.select(F.col(id_col).alias("id"), url.cast("string").alias("url"), "__key", "__h"), "warc-heads")
    n_rows = heads.count()
    bits = filter_bits(n_rows)
    blocks = scratch_table(repeat_filter(heads, "__h", bits), "warc-bits")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    groups = may_repeat(heads, "__h", blocks, bits, "__maybe").where("__maybe").groupBy("__key").agg(
        first.alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    groups = groups.where("__n > 1").select("__key", F.col("__first.id").alias("__first"), F.col("__first.url").alias("__url"), "__n")
    groups = scratch_table(groups, "warc-groups")
    marked = may_repeat(rows, "__h", blocks, bits, "__maybe").drop("__h")
    again = attach_by_key(marked.where("__maybe"), groups, "__key", "__n", n_rows)
    once = marked.where(~F.col("__maybe")).withColumns(
        {"__first": F.lit(None).cast(df.schema[id_col].dataType), "__url": F.lit(None).cast("string"), "__n": F.lit(1).cast("long")}
    )
    out = again.unionByName(once)
    revisit = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    out = out.withColumns(
        {
            "payload_digest": base32_sha1(data),
            "record_type": F.when(revisit, "revisit").otherwise("response"),
            "refers_to": F.when(revisit, F.col("__first")),
            "refers_to_url": F.when(revisit, F.col("__url")),
        }
    )
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], *added)


def _header(value: Column) -> Column:
    """A value that stays on its line: control characters become percent escapes, null a hyphen."""
    safe = F.coalesce(value.cast("string"), F.lit("-"))
    return F.when(safe.rlike("[\\x00-\\x1F\\x7F]"), F.regexp_replace(safe, "[\\x00-\\x1F\\x7F]", "%00")).otherwise(safe)


def _urn(*parts: Column) -> Column:
    """A record id made of a digest of what it names."""
    digest = F.md5(F.encode(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), "UTF-8"))
    groups = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _record_id(kind: Column, page_id: Column, payload_digest: Column) -> Column:
    """The id of a page's record: rows that share a page id but not their payload have records of their own."""
    return _urn(F.lit("page"), kind, payload_digest, page_id)


def warc_records(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None
) -> DataFrame:
    """``record string`` for each row of ``resolve_revisits``: fresh headers, and the payload of responses.

    One record more, of type ``warcinfo``, says what wrote the others, and each of them names it. ``date`` is their
    date in UTC (``2020-01-31T12:00:00Z``); now, as the driver plans the write, without it.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.when(F.col("record_type") == "response", F.coalesce(F.col(payload_col), F.lit(""))).otherwise("")
    revisit = F.col("record_type") == "revisit"
    info_id = _urn(F.lit("warcinfo"), F.lit(date))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("record_type"), F.col(id_col), F.col("payload_digest"))),
        F.concat(F.lit("WARC-Warcinfo-ID: "), info_id),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _header(F.col(url_col))),
        F.concat(F.lit("X-Page-ID: "), _header(F.col(id_col))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.lit("response"), F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _header(F.col("refers_to_url")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.encode(payload, "UTF-8")).cast("string")),
    ]
    records = df.select(F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), payload, F.lit(EOL + "\r")).alias("record"))
    about = f"software: siltworks{EOL}format: WARC File Format 1.1{EOL}"
    head = EOL.join([VERSION, "WARC-Type: warcinfo", "WARC-Record-ID: %s", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(about)}"])
    info = df.sparkSession.range(1).select(F.format_string(head + EOL + EOL + about + EOL + "\r", info_id).alias("record"))
    return info.unionByName(records)


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS) -> None:
    """Write records as compressed archives under ``path``; Spark's writer ends each with the last line feed."""
    writer = records.select("record").write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path)


_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)\s*$")
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*(.*?)\r?$")
_OPENING = VERSION.encode() + b"\r\n"

RECORD_SCHEMA = (
    "page_id string, url string, record_id string, record_type string, payload_digest string, refers_to_record string, payload binary"
)


def parse_records(pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of archives that were cut at every version line, by their content lengths.

    A payload that holds version lines itself is put together again, so at most one record is in memory. An empty
    piece stands before the first record of each archive. Raises where a length or version does not fit.
    """
    parts: list[bytes] = []
    held, need = 0, 0
    for piece in pieces:
        if not parts:
            if not piece:
                continue
            body = piece.find(b"\r\n\r\n") + 4
            length = _LENGTH.search(piece[:body]) if body > 3 else None
            if not length:
                raise ValueError("no content length, or no version line, at the head of a record")
            need = body + int(length[1]) + 4
            parts, held = [piece], len(piece)
        else:
            parts += [_OPENING, piece]
            held += len(_OPENING) + len(piece)
        if held < need:
            continue
        whole = parts[0] if len(parts) == 1 else b"".join(parts)
        parts = []
        if held != need or not whole.endswith(b"\r\n\r\n"):
            raise ValueError("a record does not end where its length says")
        body = whole.index(b"\r\n\r\n") + 4
        field = {k.lower().decode(): v.decode() for k, v in _FIELD.findall(whole[:body])}
        yield {
            "page_id": field.get("x-page-id"),
            "url": field.get("warc-target-uri"),
            "record_id": field.get("warc-record-id"),
            "record_type": field.get("warc-type"),
            "payload_digest": field.get("warc-payload-digest", "").removeprefix("sha1:"),
            "refers_to_record": field.get("warc-refers-to"),
            "payload": whole[body : need - 4],
        }
    if parts:
        raise ValueError("the last record is cut short")


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive in memory."""
    if data and not data.startswith(_OPENING):
        raise ValueError("no WARC record at byte 0")
    return parse_records(iter(data.split(_OPENING)))


_ARROW = pa.schema(
    [(name, pa.binary() if kind == "binary" else pa.string()) for name, kind in (x.split() for x in RECORD_SCHEMA.split(", "))]
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    size = 0
    for record in parse_records(piece.as_py() for batch in batches for piece in batch.column(0)):
        some.append(record)
        size += len(record["payload"])
        if size > 4_000_000 or len(some) == 500:
            yield pa.RecordBatch.from_pylist(some, schema=_ARROW)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=_ARROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, read by Spark's own reader.

    The reader cuts each archive at its version lines and hands the pieces to the parser in order; a compressed
    archive is never divided among tasks. Archives may have any size: a task holds one record at a time.
    """
    bound_batches(spark)
    pieces = spark.read.option("lineSep", _OPENING.decode()).option("pathGlobFilter", "*.gz").text(path)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_parse, RECORD_SCHEMA)


def warc_report(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read them back and resolve each revisit to its original response.

    A revisit without its response, or a payload that does not have the digest its header states, is an error.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(warc_records(resolve_revisits(pages.select("page_id", "url", "html"))), path)
    read = read_warc(spark, path).where("record_type IN ('response', 'revisit')")
    heads = scratch_table(
        read.select(
            F.when(F.col("page_id") != "-", F.col("page_id").cast("long")).alias("page_id"),
            "url", "record_id", "record_type", "refers_to_record", "payload_digest",
            F.octet_length("payload").cast("long").alias("stored_bytes"), base32_sha1(F.col("payload")).alias("stored_digest"),
        ),
        "warc-read",
    )
    responses = heads.where("record_type = 'response'")
    revisits = heads.where("record_type = 'revisit'")
    asked = revisits.groupBy("refers_to_record").agg(F.count(F.lit(1)).alias("__n"))
    # Rows that repeat page and payload share a record id, a size and a digest.
    originals = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.min("page_id").alias("refers_to"), F.min("stored_bytes").alias("original_bytes"), F.min("stored_digest").alias("original_digest")
    )
    originals = scratch_table(asked.join(originals, "refers_to_record", "left"), "warc-originals")
    found = attach_by_key(revisits, originals, "refers_to_record", "__n", max(1, heads.count()))
    found = found.select(
        "page_id", "url", "record_type", "refers_to", F.col("original_bytes").alias("payload_bytes"), "payload_digest",
        F.col("original_digest").alias("digest_found"),
    )
    whole = responses.select(
        "page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), F.col("stored_bytes").alias("payload_bytes"),
        "payload_digest", F.col("stored_digest").alias("digest_found"),
    )
    out = whole.unionByName(found)
    wrong = F.raise_error(F.concat(F.lit("no payload with the stated digest for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))
    sound = F.when(F.col("digest_found") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong.cast("string"))
    return out.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT html, min(page_id) AS first_id FROM p GROUP BY html
)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g USING (html)
"""
