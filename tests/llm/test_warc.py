"""The archive: SQL on whole tables, exact records, damage."""

import hashlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from storkline.llm import queries, warc

BIG = "x" * 1500
PAGES = [
    (1, "http://a/1", BIG, "h"), (2, "http://a/2", BIG, "h"), (7, "http://a/7\r\nWARC-Type: none", BIG, "h"), (3, None, "small", "h"),
    (4, "http://a/4", "small", "h"), (5, "u", None, "h"), (6, "u", "", None), (None, "u", BIG, "h"), (None, "u", BIG + "y", "h"), (None, "v", BIG + "y", "h"),
    (8, "é", "é" * 500, "h"), (9, "é", "é" * 500, "h"), (9, "é", "é" * 500, "h"), (10, "z", "é" * 499, "h"), (11, "z", "é" * 499, "h"),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string, header string"), path, "2024-05-06T07:08:09Z")
    return path


def expected():
    for i, url, html, _ in PAGES:
        data = (html or "").encode()
        same = [j for j, _, h, _ in PAGES if (h or "").encode() == data and j is not None]
        revisit = len(data) >= 1000 and same and i != max(same)
        yield (i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)


def test_report(spark, archive):
    out = warc.report(warc.read(spark, archive)).collect()
    assert all(r.sound for r in out)
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out))) == sorted(map(str, expected()))


def test_payloads_are_stored_once_and_records_are_exact(spark, archive):
    stored = spark.read.parquet(f"{archive}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == len({(h or "").encode() for _, _, h, _ in PAGES})
    records = [bytes(r.record) for r in warc.records(warc.read(spark, archive)).collect()]
    own = hashlib.sha1(BIG.encode()).hexdigest()
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    holder = next(h["WARC-Record-ID"] for h, _ in map(one_record, records) if h["WARC-Record-ID"].startswith("<urn:page:7:"))
    for i, kind, extra, block in ((7, "response", "", BIG), (1, "revisit", f"{profile}WARC-Refers-To: {holder}\r\n", "")):
        url = "http://a/1" if i == 1 else "http://a/7%0D%0AWARC-Type: none"
        found = next(r for r in records if f"<urn:page:{i}:".encode() in r.split(b"WARC-Date")[0])
        name = one_record(found)[0]["WARC-Record-ID"]
        assert found == (
            f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nWARC-Target-URI: {url}\r\n"
            f"WARC-Payload-Digest: sha1:{own}\r\nWARC-Payload-Length: 1500\r\n{extra}"
            f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
        ).encode()


def read_stream(stream):
    """A reader of its own: header lines up to an empty one, as many bytes as they say, two line ends."""
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            assert line.endswith(b"\r\n")
            name, value = line.decode().rstrip("\r\n").split(": ", 1)
            assert name not in fields
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        assert len(block) == int(fields["Content-Length"]) and stream.read(4) == b"\r\n\r\n"
        yield fields, block


def one_record(record):
    (found,) = read_stream(io.BytesIO(record))
    return found


def test_a_stream_of_records_can_be_read(spark, archive):
    """All records one after the other, as in a file, through a reader that knows the format alone."""
    stream = io.BytesIO(b"".join(bytes(r.record) for r in warc.records(warc.read(spark, archive)).collect()))
    found = list(read_stream(stream))
    assert len(found) == len(PAGES) == len({f["WARC-Record-ID"] for f, _ in found})
    by_id = {f["WARC-Record-ID"]: (f, block) for f, block in found}
    restored = []
    for fields, block in found:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        if fields["WARC-Type"] == "revisit":
            assert not block and fields["WARC-Profile"]
            block = by_id[fields["WARC-Refers-To"]][1]
            assert by_id[fields["WARC-Refers-To"]][0]["WARC-Type"] == "response"
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest() and int(fields["WARC-Payload-Length"]) == len(block)
        restored.append((fields["WARC-Record-ID"].split(":")[2], block.decode()))
    assert sorted(restored) == sorted(("" if i is None else str(i), h or "") for i, _, h, _ in PAGES)
    assert sum(f["WARC-Type"] == "revisit" for f, _ in found) == sum(row[3] == "revisit" for row in expected())


def test_copies_in_a_whole_table(spark, tmp_path):
    """The shared pages, a third of them again under other ids: every payload once, every copy a revisit."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    n = pages.count()
    again = pages.filter("page_id % 3 = 0 and octet_length(html) >= 1000").withColumn("page_id", F.col("page_id") + 10_000_000)
    warc.write(pages.unionByName(again), str(tmp_path / "c"))
    out = warc.report(warc.read(spark, str(tmp_path / "c"))).collect()
    copies = {r.page_id: r.refers_to for r in out if r.record_type == "revisit"}
    assert len(out) == n + again.count() and all(r.sound for r in out)
    assert copies == {r.page_id - 10_000_000: r.page_id for r in again.select("page_id").collect()}
    assert spark.read.parquet(str(tmp_path / "c" / "payloads")).count() == pages.select("html").distinct().count()


def test_damage_is_seen(spark, archive, tmp_path):
    for part in ("headers", "payloads"):
        table = spark.read.parquet(f"{archive}/{part}")
        if part == "payloads":
            table = table.withColumn("payload", F.when(F.length("payload") == 1500, F.lit(b"other")).otherwise(F.col("payload")))
        table.write.parquet(str(tmp_path / part))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path)).collect()


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_content_addressed_warc(spark, sf)
    own = {tuple(r) for r in out.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert own == set(con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLE_SQL['op7_content_addressed_warc']})").fetchall())


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string, digest string, holder long"), str(tmp_path / "e"))
    assert warc.report(warc.read(spark, str(tmp_path / "e"))).count() == 0
