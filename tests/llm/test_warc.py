from __future__ import annotations

import base64
import hashlib

import zstandard
from pyspark.sql import functions as F

from fernwalk.llm import warc as W
from tests.llm.conftest import clash, rows

PAGES = "page_id long, url string, html string"
DATA = [
    (1, "http://a.example/ä b", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c.example/\r\nX: y", "<p>same</p>"),
    (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "u", "é" * 200_000), (7, "u", "é" * 200_000), (None, "u", "<p>same</p>"), (None, "u", "alone"),
]


def want(data):
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    out = []
    for i, _, h in data:
        raw = (h or "").encode()
        to = first.get(h or "")
        many = sum((x[2] or "") == (h or "") for x in data) > 1
        revisit = many and to is not None and to != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def read_back(df, **k):
    got = W.archive(df, **k)
    return rows(got.select(F.col("record_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")))


def test_round_trip(spark):
    df = spark.createDataFrame(DATA, PAGES)
    assert read_back(df) == want(DATA)
    assert read_back(clash(df)) == want(DATA)
    assert read_back(df.limit(0)) == []


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame(DATA, PAGES)
    assert {r[3] for r in read_back(df, least=12) if r[1] < 12} == {"response"}


def test_records_are_found_by_their_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x.example/{i}", f"<p>{i}</p>" * 50) for i in range(60)], PAGES).coalesce(1)
    W.write_archives(W.mark_revisits(df), str(tmp_path / "b"), frame_bytes=3000, bundle_bytes=1500)
    bundles = spark.read.parquet(str(tmp_path / "b")).collect()
    assert len(bundles) > 1
    assert max(len(W.read_seek_table(bytes(b.data))) for b in bundles) > 1
    for b in bundles:
        data = bytes(b.data)
        frames = W.read_seek_table(data)
        assert {r.frame for r in b.records} == set(range(len(frames)))
        for r in b.records:
            (head, block), = W.parse_records(W.read_record(data, r.frame, r.offset, r.length))
            assert head["warc-record-id"] == f"<urn:page:{r.record_id}>"
            assert block.endswith(f"<p>{r.record_id}</p>".encode() * 50)
        # Any reader of the format can unpack the whole bundle, as the seek table is a frame to skip.
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert sum(1 for _ in W.parse_records(whole)) == len(b.records)
