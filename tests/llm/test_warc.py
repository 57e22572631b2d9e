import base64
import gzip
import hashlib
import io

import pytest

from framelark.llm import warc


def test_round_trip(spark, odd_pages):
    rows = odd_pages.collect()
    made = warc.round_trip(spark, odd_pages).collect()
    assert len(made) == len(rows)
    for page in rows:
        payload = (page.html or "").encode()
        same = [r.page_id for r in rows if (r.html or "") == (page.html or "") and r.page_id is not None]
        last = max(same) if same else None
        revisit = last is not None and (page.page_id is None or page.page_id < last)
        want = (page.page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)
        assert want in [tuple(r) for r in made]


def test_least_bytes(spark, odd_pages):
    made = warc.round_trip(spark, odd_pages, least_bytes=10_000).collect()
    assert {r.record_type for r in made} == {"response"}


def test_payloads_urls_and_real_gzip(spark, odd_pages, tmp_path):
    path = warc.write(odd_pages)
    archives = spark.read.parquet(path)
    got = warc.read(archives).collect()
    html = {r.page_id: (r.html or "").encode() for r in odd_pages.collect() if r.page_id}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.page_id and r.record_type == "response")
    assert {r.url for r in got if r.page_id == 8} == {"http://xexample.com/en/%0Aq"}
    blob = archives.first().archive
    assert gzip.GzipFile(fileobj=io.BytesIO(blob)).read().startswith(b"WARC/1.1\r\n")
    file = tmp_path / "a.warc.gz"
    file.write_bytes(blob)
    again = warc.read(spark.read.format("binaryFile").load(str(file)).select("content").withColumnRenamed("content", "archive"))
    assert again.count() == archives.first().records


def test_damage_is_found():
    record = warc._record(1, "http://x/", b"<p>body</p>", warc.base32_sha1(b"<p>body</p>"), None)
    assert [r.payload for r in warc.read_records(record * 3)] == [b"<p>body</p>"] * 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(record[:-9]))
    wrong = warc._record(1, None, b"abc", warc.base32_sha1(b"abd"), None)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(wrong))


def test_empty(spark, no_pages):
    assert warc.round_trip(spark, no_pages).count() == 0
