"""WARC: files written, normalised and read back, against plain gzip, hashes and hand-made damage."""

import base64
import gzip
import hashlib
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from doselake.llm import warc

PAGES = "page_id bigint, url string, html string"


def brute(rows):
    """page_id, payload bytes, digest, type and target of each row, by comparing payloads."""
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [x[0] for x in rows if (x[2] or "").encode() == body and x[0] is not None]
        last = max(ids, default=None)
        revisit = last is not None and i != last
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_pages_come_back(spark):
    rows = [(i, f"http://a/{i % 7}", f"page {i % 9}" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "x\r\ny: zé %20", ""), (102, "u", "\r\n\r\nWARC/1.1\r\n\r\n日\u0000"), (103, "long", "abé" * 900_000)]
    rows += [(110 + i, "noise", hashlib.shake_256(bytes([i])).hexdigest(50_000)) for i in range(12)]
    rows += [(None, "no id", "page 0"), (None, "no id", "only here"), (7, "http://a/0", rows[7][2]), (200, "tie", "tie"), (200, "tie", "tie")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "k": F.lit(2), "id": F.lit(3), "last": F.lit(4)}).repartition(3)
    normalised = warc.archive_pages(df, archive_bytes=2_000)
    got = warc.read_archives(normalised).collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r.id, bytes(r.payload)) in texts for r in got if r.record_type == "response")
    assert {r.uri for r in got if r.id == 101} == {"x%0D%0Ay:%20z%C3%A9%20%20"}
    files = normalised.collect()
    assert len(files) > 3 and sum(f.records for f in files) == len(rows)
    for f in files:  # each member alone is one record, and they fill the file
        data, end = open(f.archive, "rb").read(), 0
        entries = [json.loads(x) for x in open(f["index"])]
        for e in entries:
            assert e["offset"] == end
            end += e["length"]
            record = gzip.decompress(data[e["offset"]:end])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
        assert end == len(data) == f.bytes and len(entries) == f.records


def test_small_payloads_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "x"), (4, "d", "x"), (5, "e", None)], PAGES)
    got = {r.id: r.refers_to for r in warc.read_archives(warc.archive_pages(df, least_bytes=2), whole=False).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None, 5: None}
    assert warc.read_archives(warc.archive_pages(df.limit(0))).count() == 0


def test_hot_payload_leaves_its_bytes_behind(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") < 10, F.lit("few")).otherwise(F.col("id").cast("string")).alias("html"))
    rows = warc.choose_types(df)
    assert rows.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    kinds = {(r.refers_to, r.n) for r in rows.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count("*").alias("n")).collect()}
    assert kinds == {(2997, 999), (8, 5)}


def record(content, kind="response", more=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\n{more}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    whole = record(b"a: b", "warcinfo") + record(b"plain body") + record(b"HTTP/1.1 200 OK\r\n\r\nbody", more="Content-Type: application/http\r\n")
    forms = {"stream": gzip.compress(whole), "members": gzip.compress(whole[:50]) + gzip.compress(whole[50:]), "plain": whole}
    for name, data in forms.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    normalised = warc.normalise(warc.archives_in(spark, str(tmp_path)), str(tmp_path / "out"))
    assert [r.records for r in normalised.collect()] == [3, 3, 3]
    got = warc.read_archives(normalised).collect()
    assert sorted(bytes(r.payload) for r in got) == [b"body"] * 3 + [b"plain body"] * 3
    assert {(r.record_id, r.id, r.record_type) for r in got} == {("urn:uuid:1", None, "response")}


@pytest.mark.parametrize("data", [
    gzip.compress(record(b"x" * 9))[:-12], gzip.compress(record(b"x" * 9)[:-9]), b"HTTP/1.1 200\r\n\r\n", record(b"x")[:-4] + b"abcd", b"WARC/1.1\r\nWARC-Type",
])
def test_damage_is_named(tmp_path, data):
    path = str(tmp_path / "a.warc.gz")
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises((ValueError, zlib.error)):
        warc.normalise_file(path, f"{path}.new", f"{path}.index", 6)


def test_wrong_digest_is_an_error(tmp_path):
    path = str(tmp_path / "a.warc")
    with open(path, "wb") as f:
        f.write(record(b"x", more="WARC-Payload-Digest: sha1:ABC\r\n"))
    warc.normalise_file(path, f"{path}.new", f"{path}.index", 6)
    fs, at = warc.resolve(f"{path}.new")
    with fs.open_input_file(at) as file, pytest.raises(ValueError, match="digest"):
        warc.read_member(file, 0, os.path.getsize(f"{path}.new"), False)
