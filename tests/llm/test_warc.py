import base64
import hashlib
import io

import pytest
import zstandard

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGES = [(5, "http://a/x y\r\nEvil: 1", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (4, None, None), (6, "http://c", ""), (7, "http://d/é", "ü" * 200_000), (3, "http://b", "<p>same</p>"), (3, "http://b", "other"), (None, "http://e", "<p>same</p>"), (None, "http://f", "alone\r\n\r\nWARC/1.1\r\n")]


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = body in first and first[body] != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=repr)


def digest(index):
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r["page"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in warc.read_records(index).collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA).repartition(2)


def test_round_trip(pages, tmp_path):
    index = warc.write_bundles(pages, frame_bytes=500, bundle_bytes=2000, folder=str(tmp_path / "w"))
    assert digest(index) == brute(PAGES)
    assert digest(warc.write_bundles(pages, min_bytes=1)) == brute(PAGES, 1)


def test_any_tool_reads_a_bundle_and_one_frame_alone(pages, tmp_path):
    index = warc.write_bundles(pages, frame_bytes=500, folder=str(tmp_path / "w")).collect()
    for path in {r["bundle"] for r in index}:
        whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
        mine = [r for r in index if r["bundle"] == path]
        assert len(whole) == sum(r["length"] for r in mine)
        reader = warc.Reader(path)
        for r in mine:
            raw = reader.frame(r["frame"])[r["offset"] : r["offset"] + r["length"]]
            fields, payload = warc.parse(raw)
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and "Evil" not in fields
            if fields["WARC-Type"] == "response":
                assert warc.digest32(payload) == fields["WARC-Payload-Digest"].removeprefix("sha1:")
            assert io.BytesIO(raw).readline() == b"WARC/1.1\r\n"


def test_empty(spark):
    assert digest(warc.write_bundles(spark.createDataFrame([], SCHEMA))) == []


def test_clashing_columns(pages):
    from pyspark.sql import functions as F

    assert digest(warc.write_bundles(pages.withColumns({c: F.lit("x") for c in ("id", "payload", "_id", "_sha", "bundle", "frame")}))) == brute(PAGES)
