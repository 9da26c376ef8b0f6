import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from inkstrata.llm import warc


def test_records_and_streams():
    payloads = [b"", b"one", "é\r\n\r\nWARC/1.1\r\n".encode(), b"x" * 300_000]
    whole = [warc.record(i, f"http://h/{i}\r\n", p, None) for i, p in enumerate(payloads)] + [warc.record(None, None, b"one", 1)]
    for stream in (gzip.compress(b"".join(whole)), b"".join(gzip.compress(x) for x in whole)):
        for size in (7, 1000, 1 << 20):
            if size > 7 or len(stream) < 5000:
                pieces = (stream[i : i + size] for i in range(0, len(stream), size))
                assert list(warc.split_records(warc.inflate(pieces))) == whole
    rows = [warc.parse_record(x) for x in whole]
    assert [r["payload_bytes"] for r in rows] == [0, 3, len(payloads[2]), 300_000, 3]
    assert rows[4] == {"page_id": None, "payload_bytes": 3, "payload_digest": warc.digest_of(b"one"), "record_type": "revisit", "refers_to": 1, "url": None}
    assert rows[0]["url"] == "http://h/0%0D%0A"
    with pytest.raises(ValueError):
        warc.parse_record(whole[1].replace(b"one", b"two"))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([whole[1][:-9]])))


@pytest.mark.parametrize("copies", [warc.MAX_COPIES, 0])
def test_round_trip(spark, tmp_path, monkeypatch, copies):
    monkeypatch.setattr(warc, "MAX_COPIES", copies)
    rows = [(1, "http://a/", "same"), (7, "http://b/", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (9, "u", "own"), (9, "u", "own"), (None, "u", "lost"), (None, "u", "lost")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).repartition(3)
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == sorted(
        [(1, 4, "revisit", 7), (7, 4, "response", None), (3, 4, "revisit", 7), (4, 0, "revisit", 5), (5, 0, "response", None), (-1, 4, "revisit", 7)]
        + [(9, 3, "response", None)] * 2 + [(-1, 4, "response", None)] * 2
    )
    assert all(r.record_type == "response" for r in warc.round_trip(pages, min_bytes=10).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_offsets_and_members(spark, tmp_path):
    pages = spark.range(50).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(string(id), 50) as html").repartition(2)
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    names = warc.write_archives(pages, raw)
    assert warc.normalise(spark, names, raw, out) == 50
    zlib_members = 0
    for name in names:
        data = (tmp_path / "raw" / name).read_bytes()
        one = zlib.decompressobj(31)
        one.decompress(data)
        assert one.eof and not one.unused_data  # monolithic
        data = (tmp_path / "out" / name).read_bytes()
        for row in spark.read.schema(warc.INDEX).json(f"{out}/{name}.idx").collect():
            member = zlib.decompressobj(31)
            whole = member.decompress(data[row.offset : row.offset + row.length])
            assert member.eof and not member.unused_data and warc.parse_record(whole)["page_id"] == row.page_id
            zlib_members += 1
    assert zlib_members == 50
