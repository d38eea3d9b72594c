"""WARC archives with revisit records in place of repeated payloads."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, scratch_dir, shuffle_cleanup

VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
#: Repeated payloads up to this number are broadcast (about 100 bytes each), so that no page is shuffled.
FEW = 200_000
#: Parts that the headers of one payload are dealt into.
SALTS = 32
#: Payloads of more than one repeated row in so many are broadcast in any case; there are no more.
OFTEN = 1000


def base32_of_hex(digest: Column) -> Column:
    """Hexadecimal SHA-1 as base 32: ten digits make eight."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_bytes: int = 0, few: int = FEW) -> DataFrame:
    """Pages with bytes, digest, copy (1, 2, .. of equal page_id and payload) and original (null: the
    page is a response).

    Only headers meet by payload digest, combined by (digest, salt, page_id) first.  The largest
    page_id of a digest with at least ``min_bytes`` bytes is the original.  Up to ``few`` repeated
    payloads are broadcast to the pages; of more, those of more than one in OFTEN repeated rows are, and
    each other page's decision is made among headers and joined to the page by page_id and digest.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS).cast("long")).alias("salt")
    heads = pages.groupBy("digest", "bytes", salt, "page_id").agg(F.count("*").alias("n"))
    largest = F.max(F.when(F.col("bytes") >= min_bytes, F.col("page_id")))
    found = heads.groupBy("digest").agg(largest.alias("original"), F.sum("n").alias("n"), F.max("n").alias("most"), F.collect_set("salt").alias("salts"))
    with shuffle_cleanup(pages.sparkSession):
        groups = Table(found.where("n > 1")).df
    size, most, repeated = groups.agg(F.count("*"), F.coalesce(F.max("most"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size <= few:
        rows = pages.join(F.broadcast(groups.select("digest", "original", "most")), "digest", "left")
    else:
        often = F.col("n") * OFTEN > repeated
        hot = groups.where(often).select(F.col("digest").alias("h"), F.struct("original", "most").alias("hot"))  # fewer than OFTEN rows
        by_salt = groups.where(~often).select("digest", "original", "most", F.explode("salts").alias("salt"))
        decided = heads.join(by_salt, ["digest", "salt"]).select(F.col("digest").alias("d"), F.col("page_id").alias("p"), "original", "most")
        rows = pages.join(F.broadcast(hot), F.col("digest") == F.col("h"), "left")
        # Pages of a frequent payload have their answer and meet no other: their key is spread.
        key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))
        rows = rows.withColumn("key", key).join(decided, (F.col("key") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
        rows = rows.withColumns({c: F.coalesce(f"hot.{c}", c) for c in ("original", "most")}).drop("d", "p", "h", "hot", "key")
    rows = rows.withColumn("copy", F.lit(1))
    if most > 1:  # some rows are repeated: they are numbered
        number = F.row_number().over(W.partitionBy("digest", "page_id").orderBy("url"))
        again = F.coalesce(F.col("most") > 1, F.lit(False))
        rows = rows.where(~again).unionByName(rows.where(again).withColumn("copy", number))
    own = F.col("original").isNull() | (F.col("page_id").eqNullSafe(F.col("original")) & (F.col("copy") == 1))
    return rows.withColumn("original", F.when(~own, F.col("original"))).withColumn("digest", base32_of_hex(F.col("digest"))).drop("most")


def _urn(number: Column, copy: Column) -> Column:
    """Names of records: an original is the first copy of its number with this payload."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(":"), copy.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))


def records(resolved: DataFrame, date: str | None = None) -> DataFrame:
    """One WARC/1.1 record a row as text, without its last line end; date: UTC, by default now.

    A revisit's block is the response's HTTP header, whose Content-Length is that of the payload."""
    date = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(_EOL + _EOL))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"{VERSION}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(_EOL),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("copy"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("original"), F.lit(1)))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{_EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL + _EOL),
    )
    return resolved.select(F.concat(head, block, F.lit(_EOL)).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None, records_per_file: int = 4096) -> None:
    """Writes pages as gzipped WARC files, a revisit record for each repeated payload.

    Files hold at most ``records_per_file`` records, for parallel readers; they are read as streams,
    so a file's size is not bound by memory.  The text writer ends each record with the second line end, so archives go through Spark's
    output committer to any file system, and a lost task leaves no partial file.
    """
    with shuffle_cleanup(pages.sparkSession):
        out = records(resolve(pages, min_bytes), date).write.option("lineSep", _EOL).option("compression", "gzip")
        out.option("maxRecordsPerFile", records_per_file).text(path)


def _number(urn: str | None) -> int | None:
    x = (urn or "::null").strip("<>").split(":")[2]
    return int(x) if x != "null" else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from what follows each version line; a payload that holds such a line was cut there
    and is put together again by the record's Content-Length."""
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=list(names))

    rows, held, headers, parts, missing = [], 0, None, [], 0
    for b in batches:
        for value in b.column("value").to_pylist():
            raw = value.encode("utf-8")
            if headers is None:
                if not raw:
                    continue  # before a file's first record
                head, _, raw = raw.partition(b"\r\n\r\n")
                headers = dict(x.split(": ", 1) for x in head.decode("utf-8").split(_EOL))
                missing = int(headers["Content-Length"])
            else:
                raw = VERSION.encode() + raw
            parts.append(raw)
            missing -= len(raw)
            if missing > -4:  # the block and two line ends
                continue
            block, h = b"".join(parts)[: int(headers["Content-Length"])], headers
            headers, parts = None, []
            http, _, payload = block.partition(b"\r\n\r\n")
            digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rpartition(b": ")[2])
            response = h["WARC-Type"] == "response"
            if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its size and digest")
            rows.append((_number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], _number(h.get("WARC-Refers-To")), payload.decode("utf-8") if response else None))
            held += len(block)
            if held > 8_000_000:
                yield batch(rows)
                rows, held = [], 0
    if headers is not None:
        raise ValueError(f"record {headers['WARC-Record-ID']} is cut off")
    if rows:
        yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload.  Responses are checked against their digests; revisits have no payload of their own."""
    files = spark.read.option("lineSep", VERSION).option("pathGlobFilter", "*.gz").text(path)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    return files.mapInArrow(_read, schema)


def deduplicated_archives(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes pages as deduplicated archives and returns what reading them back gives.

    pages: page_id long, url, html string (null: empty payload); other columns are ignored.  Of
    records with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is
    the response and the others revisit it.  Returns page_id, payload_bytes, payload_digest
    (base32 SHA-1 of the full payload), record_type, refers_to.

    Null page_id: a record like others, never an original unless none of its payload's records
    has a number; then they all stay responses.  Repeated rows of a page are records with names of
    their own; one of the largest page_id is the response, the rest revisit it.  Null url: the
    record has no target.  Payloads are written and read whole.  An empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark)
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
