"""WARC archives: round trips, pushdown, foreign files, commits, and the revisit rule against a plain version."""

import base64
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringStartsWith

from panelspark.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload string, target_uri int, key string, `a.b` int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, min_bytes=0):
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(last.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        size = len((t or "").encode())
        top = last.get(t or "") if size >= min_bytes else None
        revisit = top is not None and i != top
        out.append((i, size, digest(t), "revisit" if revisit else "response", top if revisit else None))
    return out


def corpus():
    rng = random.Random(4)
    texts = [f"<p>{rng.random()}é</p>" * rng.randrange(1, 400) for _ in range(60)]
    rows = [(k, f"http://h{k % 5}.example/{k}", texts[k % 45]) for k in range(60)]
    rows += [(100 + k, None, "the same page") for k in range(80)]
    rows += [(200, "u", None), (201, "v", ""), (None, "w", ""), (None, "x", "only without id"), (None, "x", "only without id")]
    rows += [(300, "twice", "t"), (300, "twice", "t"), (299, "line\r\nWARC-Type: bad", "t"), (301, "long", "\r\n\r\nWARC/1.1\r\n" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "p", 1, "k", 2) for r in corpus()], SCHEMA).repartition(4)


def key(rows):
    return sorted(map(tuple, rows), key=str)


def read_back(records):
    at = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return records.where("record_type <> 'warcinfo'").select(at("record_id"), "payload_bytes", "payload_digest", "record_type", at("refers_to"))


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"max_file_bytes": 3000, "level": 1}])
@pytest.mark.parametrize("split", [64 << 20, 20_000])
def test_round_trip_and_revisits(spark, pages, tmp_path, options, split):
    folder = f"file://{tmp_path}/a"
    warc.write_warc(warc.page_records(pages), folder, **options)
    records = warc.read_warc(spark, folder, split_bytes=split)
    assert key(read_back(records).collect()) == key(plain(corpus()))
    whole = {(r.record_id, r.payload.decode()) for r in records.where("record_type = 'response'").collect()}
    assert whole == {(f"urn:page:{'' if i is None else i}", t or "") for (i, _, t), p in zip(corpus(), plain(corpus())) if p[3] == "response"}
    assert records.where("record_type = 'warcinfo'").count() >= 1
    headers = warc.read_warc(spark, folder, split_bytes=split, payload=False)
    assert key(read_back(headers).collect()) == key(plain(corpus()))
    assert headers.where("payload is not null").count() == 0


def test_short_payloads_do_not_revisit(spark, pages, tmp_path):
    warc.write_warc(warc.page_records(pages, min_bytes=14), f"{tmp_path}/a")
    assert key(read_back(warc.read_warc(spark, f"{tmp_path}/a")).collect()) == key(plain(corpus(), 14))


def test_hot_and_cold_payloads_meet_their_response(spark, pages):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = warc.page_records(pages)
        got = [(r.record_id, r.record_type, r.refers_to) for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    name = lambda i: None if i is None else f"urn:page:{i}"
    assert key(got) == key((name(i) or "urn:page:", kind, name(to)) for i, _, _, kind, to in plain(corpus()))


def test_filters_reach_the_headers(spark, pages, tmp_path):
    folder = f"{tmp_path}/a"
    warc.write_warc(warc.page_records(pages), folder)
    records = warc.read_warc(spark, folder)
    one = records.where("record_type = 'response' and target_uri = 'http://h1.example/16'")
    assert [r.record_id for r in one.collect()] == ["urn:page:16"]
    assert records.where(F.col("target_uri").startswith("http://h1.")).count() == 12
    assert records.where("record_type in ('warcinfo', 'revisit')").where("record_type = 'response'").count() == 0
    reader = warc.WarcReader({"path": folder})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3), StringStartsWith(("target_uri",), "http"), In(("payload_digest",), ("x",)), IsNotNull(("date",)), EqualTo(("headers", "record_type"), "x")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "In", "EqualTo"]
    assert [t[0] for t in reader.tests] == ["record_type", "target_uri", "payload_digest", "date"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_unwanted_payloads_are_not_inflated(tmp_path):
    good = warc.member(warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"x" * 100_000))
    broken = bytearray(good)
    broken[-8] ^= 255  # its checksum
    (tmp_path / "m").write_bytes(bytes(broken) + good)
    with open(tmp_path / "m", "rb") as f:
        first, second = warc._sized_members(f, 0, len(good) * 2)
        assert first.column("record_id") == "a" and len(second.block()) == 100_000
        with pytest.raises(ValueError, match="checksum"):
            first.block()


def test_very_long_headers(tmp_path):
    content = warc.record_bytes([("WARC-Type", "resource"), ("WARC-Target-URI", "u" * 300_000)], b"body")
    (tmp_path / "m").write_bytes(warc.member(content))
    with open(tmp_path / "m", "rb") as f:
        (record,) = warc._sized_members(f, 0, (tmp_path / "m").stat().st_size)
        assert len(record.column("target_uri")) == 300_000 and record.block() == b"body"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n"
    one = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: http://a\r\n /folded\r\ncontent-type: application/http\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: 4\r\n\r\nk: v\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one + two)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "members.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(two + one))
    records = warc.read_warc(spark, str(tmp_path))
    got = [(r.record_id, r.target_uri, bytes(r.payload), r.payload_digest, r.content_type) for r in records.collect()]
    assert sorted(got) == sorted([("urn:a", "http://a /folded", b"abcde", digest("abcde"), "text/plain"), ("urn:b", None, b"k: v", digest("k: v"), None)] * 3, key=str)
    assert records.where(F.col("payload_digest") == digest("abcde")).count() == 3
    assert records.where("record_type = 'metadata'").count() == 3
    assert warc.read_warc(spark, str(tmp_path / "one.warc.gz")).count() == 2
    (tmp_path / "plain.warc").write_bytes(b"no archive\r\n\r\n")
    with pytest.raises(Exception, match="not a WARC record"):
        records.collect()


def test_a_wrong_digest_raises(spark, tmp_path):
    bad = warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Payload-Digest", "sha1:" + digest("other"))], b"text")
    (tmp_path / "bad.warc").write_bytes(bad)
    with pytest.raises(Exception, match="payload digest of urn:a differs"):
        warc.read_warc(spark, str(tmp_path)).collect()
    assert warc.read_warc(spark, str(tmp_path), verify=False).count() == 1


def test_only_committed_files_count(spark, pages, tmp_path):
    folder = tmp_path / "a"
    warc.write_warc(warc.page_records(pages.limit(5)), str(folder))
    (folder / "left-by-a-lost-task.warc").write_bytes(b"half a rec")
    assert read_back(warc.read_warc(spark, str(folder))).count() == 5
    warc.write_warc(warc.page_records(pages.limit(3)), str(folder))
    assert read_back(warc.read_warc(spark, str(folder))).count() == 8
    warc.write_warc(warc.page_records(pages.limit(2)), str(folder), mode="overwrite")
    assert read_back(warc.read_warc(spark, str(folder))).count() == 2
    (manifest,) = folder.glob("_manifest-*")
    listed = {n for n, _ in json.loads(manifest.read_text())["files"]}
    assert {f.name for f in folder.glob("*.gz")} == listed
    lost = warc.WarcWriter({"path": str(folder)}, False)
    warc.write_warc(warc.page_records(pages.limit(0)), f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0
    lost.abort([None])


def test_registered_query(spark, pages, tmp_path):
    pages.drop("a.b").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op11_warc_archive"](spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert key(got.collect()) == key(plain(corpus()))
