import base64
import gzip
import hashlib
import zlib

import pytest

from treeloom.llm import warc as op

SCHEMA = "page_id long, url string, html string, record_type string, path string"
ROWS = [
    (1, "http://a/", "<p>é漢</p>"), (2, "http://b/ c\r\nX: y", "<p>é漢</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "x\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (6, "http://f/", "y" * 3_000_000), (7, "http://g/", "<p>é漢</p>"), (8, "http://h/", "only"), (9, "http://i/", "twice"), (9, "http://i/", "twice"), (10, "http://j/", "\r\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_round_trip(spark):
    got = op.archive_pages(frame(spark, ROWS).repartition(3)).collect()
    want = []
    for key, _, html in ROWS:
        payload = (html or "").encode()
        last = max(k for k, _, h in ROWS if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((key, len(payload), digest, "response" if key == last else "revisit", None if key == last else last))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want, key=lambda w: w[0])


def test_small_payloads_are_responses_and_null_ids(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (None, "u", "abc")]
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in op.archive_pages(frame(spark, rows), smallest=3).collect()}
    assert got == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None)}
    assert op.archive_pages(frame(spark, [])).collect() == []


def test_members_and_index(spark, tmp_path):
    written = op.write_archives(spark.createDataFrame([(k, u, h, None) for k, u, h in ROWS], "id long, url string, payload string, refers_to long").coalesce(1), f"file://{tmp_path}/a")
    source = written.first()["path"]
    whole = open(source, "rb").read()
    one = zlib.decompressobj(31)
    text = one.decompress(whole)
    assert one.unused_data == b"" and text.count(b"WARC-Record-ID") == len(ROWS)  # a single member
    normal = op.normalise_archives(written, f"file://{tmp_path}/b").first()
    data, at = open(normal["path"], "rb").read(), 0
    for line in open(normal["path"] + ".idx"):
        offset, length, name = __import__("json").loads(line)
        assert offset == at and name in zlib.decompress(data[offset : offset + length], 31).decode("utf-8", "replace")
        at += length
    assert at == len(data) and gzip.decompress(data) == text and normal["records"] == len(ROWS)
    again = op.normalise_archives(spark.createDataFrame([(normal["path"],)], "path string"), f"file://{tmp_path}/c").first()
    assert open(again["path"], "rb").read() == data  # already normal archives stay as they are


def test_cut_off_archives_are_errors(tmp_path):
    data = gzip.compress(op.record("1", "u", b"payload" * 1000, "d", None))
    (tmp_path / "x.gz").write_bytes(data[:-20])
    with open(tmp_path / "x.gz", "rb") as source, pytest.raises(ValueError):
        list(op.inflated(source))
    (tmp_path / "y.gz").write_bytes(data + b"\0" * 7)
    with open(tmp_path / "y.gz", "rb") as source:
        assert b"".join(op.inflated(source)) == gzip.decompress(data)
