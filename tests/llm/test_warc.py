import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lakeindex.llm.warc import AHEAD, Files, WarcReader, archived_pages, gzip_record, hex_digest, index_archive, read_warc, write_pages

BIG = "x" * 1500
PAGES = [(1, "http://a/1", BIG), (2, None, BIG), (3, "http://a/3", "é" * 600), (4, "http://a/\r\n4", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", BIG), (9, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 60), (None, "u", BIG), (3, "http://a/3", "é" * 600)]


def expected():
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        first = max(same) if same and len(data) >= 1000 else i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    for compression in ("none", "gzip"):
        path = f"file://{tmp_path}/{compression}"
        write_pages(df, path, compression=compression)
        archive = read_warc(spark, path, verify=True)
        assert sorted(map(tuple, archived_pages(archive).collect()), key=str) == expected()
        bodies = {(r.record_id, bytes(r.payload).decode()) for r in archive.where("record_type = 'response'").collect()}
        assert ("<urn:page:3>", "é" * 600) in bodies and ("<urn:page:6>", "") in bodies
        # Filters on headers reach the reader, and payloads are left where they are.
        some = read_warc(spark, path, payload=False).where((F.col("record_type") == "revisit") & F.col("refers_to").isin("<urn:page:8>"))
        assert sorted(r.record_id or "" for r in some.collect()) == ["", "<urn:page:1>", "<urn:page:2>"]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" in plan and "Filter " not in plan


def test_ranges_find_each_record_once(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    write_pages(df, f"file://{tmp_path}/w")
    whole = read_warc(spark, f"file://{tmp_path}/w").count()
    assert whole == len(PAGES)
    for n in (1, 700, 5000, 1 << 30):
        index_archive(spark, f"file://{tmp_path}/w", n)
        parts = WarcReader({"path": f"file://{tmp_path}/w"}).partitions()
        assert len(parts) == {1: len(PAGES), 1 << 30: 1}.get(n, len(parts)) and (n > 700 or len(parts) > 3)
        assert read_warc(spark, f"file://{tmp_path}/w").count() == whole


def test_revisits_name_their_profile(spark, tmp_path):
    write_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    records = [p for p in (next((tmp_path / "w").glob("part*")).read_bytes()).split(b"WARC/1.1\r\nWARC-Type: ")[1:]]
    heads = [p.split(b"\r\n\r\n")[0] for p in records]
    again = [h for h in heads if h.startswith(b"revisit")]
    assert len(again) == 3 and all(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in h and b"WARC-Refers-To: <urn:page:8>" in h for h in again)
    assert not any(b"WARC-Profile" in h for h in heads if h.startswith(b"response"))


@pytest.mark.parametrize("payload", ["true", "false"])
def test_archives_that_end_early_are_errors(tmp_path, payload):
    body = b"r" * (3 * AHEAD)  # beyond what is read ahead
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    read = lambda at: [r["payload_bytes"] for b in WarcReader({"path": str(at), "payload": payload}).read(Files(str(at), 0, None if at.suffix == ".gz" else at.stat().st_size)) for r in b.to_pylist()]
    whole, packed = tmp_path / "a.warc", tmp_path / "b.warc.gz"
    whole.write_bytes(one * 2)
    packed.write_bytes(gzip_record(one) * 2)
    assert read(whole) == read(packed) == [len(body)] * 2
    for at, data in ((tmp_path / "c.warc", (one * 2)[:-100]), (tmp_path / "d.warc", one + one[:20]), (tmp_path / "e.warc.gz", packed.read_bytes()[:-30]), (tmp_path / "f.warc.gz", gzip_record(one[:-200]))):
        at.write_bytes(data)
        with pytest.raises(ValueError):
            read(at)


def test_skips_what_filters_reject(tmp_path):
    records = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(body)}\r\nFolded: a\r\n b\r\n\r\n".encode() + body for i, (kind, body) in enumerate([("warcinfo", b"i" * 10), ("response", b"r" * 300_000), ("request", b"q")])]
    plain, packed = tmp_path / "a.warc", tmp_path / "b.warc.gz"
    plain.write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    packed.write_bytes(b"".join(gzip_record(r + b"\r\n\r\n") for r in records))
    assert gzip.decompress(packed.read_bytes()) == plain.read_bytes()
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    for path in (plain, packed):
        reader = WarcReader({"path": str(path)})
        assert list(reader.pushFilters([EqualTo(("record_type",), "request"), StringStartsWith(("target_uri",), "u"), GreaterThan(("offset",), 3)])) == [GreaterThan(("offset",), 3)]
        rows = [r for b in reader.read(Files(str(path), 0, None)) for r in b.to_pylist()]
        assert [(r["target_uri"], r["payload"]) for r in rows] == [("u2", b"q")]
        assert len(reader.partitions()) == 1 and os.path.exists(path)


def test_empty(spark, tmp_path):
    write_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_digests():
    assert hex_digest("sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ") == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert hex_digest("sha1:DA39A3EE5E6B4B0D3255BFEF95601890AFD80709") == "da39a3ee5e6b4b0d3255bfef95601890afd80709" and hex_digest(None) is None
