import base64
import hashlib

import pytest

from corpusloom.llm.warc import read_records, transactions, write_captures


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, "<p>é\r\n\r\nHTTP/1.1</p>"), (4, "http://b/\n4%\"\r\n x", None), (5, "http://b/5", ""), (0, "http://c/", "x" * 300000), (None, "u", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (None, None, "only")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string").cache()


def test_round_trip(spark, pages):
    got = transactions(pages).collect()
    html = {(r.page_id, r.html or "") for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.response.payload).decode()) in html
        assert r.request.warc_type == "request" and r.metadata.concurrent_to == r.capture_id == r.request.concurrent_to
    by = {(r.page_id, r.payload_digest): r for r in got}
    digest = base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()
    assert by[1, digest].record_type == "response" and by[1, digest].refers_to is None
    assert by[2, digest].refers_to == 1 and by[None, digest].refers_to == 1 and by[2, digest].payload_bytes == 11
    empty = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert by[4, empty].record_type == "response" and by[5, empty].refers_to == 4
    assert sum(r.page_id == 2 for r in got) == 2
    assert {(r.page_id, r.url) for r in got} == {(r.page_id, r.url) for r in pages.collect()}


def test_minimum_and_empty(spark, pages):
    got = transactions(pages.where("page_id in (1, 2, 4, 5)"), min_revisit_bytes=1, with_payload=False).collect()
    assert {(r.page_id, r.record_type) for r in got} == {(1, "response"), (2, "revisit"), (4, "response"), (5, "response")}
    assert all(r.response.payload is None for r in got)
    assert transactions(pages.where("false")).count() == 0


def test_archives_are_plain_warc(spark, pages, tmp_path):
    import gzip

    path = write_captures(pages.where("page_id = 3").coalesce(1), f"file://{tmp_path}").where("n_captures > 0").first().path
    text = gzip.open(path.removeprefix("file://")).read()
    assert text.count(b"WARC/1.1\r\n") == 3 and b"WARC-Type: response\r\n" in text and text.endswith(b"\r\n\r\n")
    assert read_records(spark.createDataFrame([(path,)], "path string")).count() == 3
