"""A content-addressed WARC/1.1 archive.

Payload bytes are stored once under their SHA-256, which is checked against the bytes when they are
written and read. The headers of the records are stored apart, one row a record. Joining both by the
digest gives the records back byte by byte. All work is DataFrame functions; payloads that stand alone,
usually nearly all, are written where they are read.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storkline.session import cut

#: a payload of fewer bytes is never written as a revisit
REVISIT_BYTES = 1000
_END = "\r\n"
#: characters that no header line and no URI may hold; they are written by their number, as URIs do
_CONTROL = [chr(c) for c in (*range(0x20), 0x7F)]
#: fixed value: the profile of records that repeat a payload
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    plain = reduce(lambda v, c: F.replace(v, F.lit(c), F.lit(f"%{ord(c):02X}")), _CONTROL, value)
    return F.concat(F.lit(f"{name}: "), F.when(value.rlike("[\\x00-\\x1f\\x7f]"), plain).otherwise(value), F.lit(_END))


def _name(page_id: Column, row: Column) -> Column:
    """A record's id: the page's, and a number that no other row has."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def describe(pages: DataFrame, date: str | None = None) -> DataFrame:
    """`page_id`, `digest` (SHA-256), `n_bytes` of the payload and `header` of the record of every page. Of
    records with one payload of REVISIT_BYTES or more, that with the largest page_id is the response and the
    others revisit it; all others are responses. `date` is the records' date, by default the present.

    The length in a header is that of the block that follows it: none for a revisit. The payload's length
    has a line of its own. A null html is an empty payload. A page without page_id can only revisit; where no
    page of a payload has one, all are responses. Rows that repeat a page_id are records of their own, each
    with its own id. Other columns are ignored.
    """
    measured = _payloads(pages).select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    measured = cut(measured.withColumn("row", F.monotonically_increasing_id()))
    # written, so that the join stands alone and the pages of a frequent payload can be split among tasks
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    holders = cut(measured.groupBy("digest").agg(F.max(named).alias("holder")))
    holder = F.col("holder.page_id")
    revisit = (F.col("n_bytes") >= REVISIT_BYTES) & holder.isNotNull() & ~F.col("page_id").eqNullSafe(holder)
    size = F.col("n_bytes").cast("string")
    moment = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = F.concat_ws(
        "", F.lit(f"WARC/1.1{_END}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("page_id"), F.col("row"))), _line("WARC-Date", F.lit(moment)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), _line("WARC-Payload-Length", size),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _name(holder, F.col("holder.row"))))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.when(revisit, "0").otherwise(size)), F.lit(_END),
    )
    return measured.join(holders, "digest").select("page_id", "digest", "n_bytes", lines.alias("header"))


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write the archive of the pages: `headers` and `payloads` below the path."""
    described = describe(pages, date)
    described.write.parquet(f"{path}/headers")
    spark = pages.sparkSession
    headers = spark.read.schema(described.schema).parquet(f"{path}/headers")
    several = cut(headers.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    own = _payloads(pages).select("digest", "payload")
    alone = own.join(several, "digest", "left_anti")
    shared = own.join(several, "digest", "left_semi").groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min(F.xxhash64("payload")).alias("low"), F.max(F.xxhash64("payload")).alias("high")
    )
    same = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("different payloads have one digest"))).otherwise(F.col("payload"))
    alone.unionByName(shared.select("digest", same.alias("payload"))).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """`header` and `payload` of every record. Raises an error if stored bytes do not fit their digest."""
    headers = spark.read.schema("page_id long, digest string, n_bytes long, header string").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("stored payload is damaged")))
    return headers.join(stored.select("digest", sound.alias("payload")), "digest").select("header", "payload")


def records(archive: DataFrame) -> DataFrame:
    """`record`: the bytes of each record as in a WARC file. A revisit has no block of its own there."""
    block = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select(F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(_END * 2), "UTF-8")).alias("record"))


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").rlike(rf"(?:^|\n){name}: "), found)


def _page(name: str) -> Column:
    return F.nullif(F.regexp_extract(_field(name), "<urn:page:(-?[0-9]*):[0-9]+>", 1), F.lit("")).cast("long")


def report(archive: DataFrame) -> DataFrame:
    """What the records of an archive say: `page_id`, `payload_bytes`, `payload_digest` (SHA-1 of the
    bytes restored), `record_type`, `refers_to`, `sound` (the header names that digest and length, and the length of the block)."""
    size, digest = F.octet_length("payload").cast("long"), F.sha1("payload")
    named = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (_field("WARC-Payload-Length").cast("long") == size)
    named &= _field("Content-Length").cast("long") == F.when(_field("WARC-Type") == "revisit", F.lit(0)).otherwise(size)
    return archive.select(
        _page("WARC-Record-ID").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"), named.alias("sound"),
    )
