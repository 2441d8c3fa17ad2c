import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing
from veilspark.llm.queries import op10_warc
from veilspark.llm.warc import FORMAT, WarcReader, archive, digest, read_archive, record

PAGES = "page_id long, url string, html string"
ROWS = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é😀" * 40_000), (6, "http://e/", "WARC/1.1\r\n\r\n\x1f\x8b"), (7, "http://f/", "other"), (7, "http://f/", "other"), (None, "http://g/", "same"), (8, "http://h/", "same")]


def want(rows):
    first, out = {}, []
    for i, _, t in rows:
        b = (t or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    for i, _, t in rows:
        b = (t or "").encode()
        same = first.get(b) == i or b not in first
        out.append((i or 0, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else first[b]))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    clashing(spark.createDataFrame(ROWS, PAGES), "id", "k", "s", "sha1", "first").write.parquet(f"{tmp_path}/pages.parquet")
    got = op10_warc(spark, str(tmp_path)).collect()
    assert sorted(((r["page_id"] or 0, *tuple(r)[1:]) for r in got), key=str) == want(ROWS)


def test_payloads_filters_and_headers(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    archive(spark.createDataFrame(ROWS, PAGES).coalesce(1), path)
    r = read_archive(spark, path)
    texts = {x["record_id"].split(":")[2]: bytes(x["payload"]) for x in r.filter("record_type = 'response'").collect()}
    assert texts["5"] == ("é😀" * 40_000).encode() and texts["6"] == "WARC/1.1\r\n\r\n\x1f\x8b".encode()
    assert r.filter("record_type = 'revisit'").filter("payload is not null or refers_to is null").count() == 0
    assert r.filter("record_type in ('revisit') and target_uri like 'http://a%'").count() == 1
    assert read_archive(spark, path, payload="false").filter("payload is not null").count() == 0
    assert {x["http_length"] for x in read_archive(spark, path, payload="false").filter("payload_digest = '" + digest(b"same") + "'").collect()} == {4}
    for f in tmp_path.glob("w/*.warc.gz"):  # any gzip reader can read it
        assert gzip.decompress(f.read_bytes()).count(b"WARC-Type: ") == len(ROWS)


def test_headers_come_first_and_unwanted_payloads_stay_undecoded(spark, tmp_path, monkeypatch):
    archive(spark.createDataFrame([(1, "http://a/", "x" * 10_000_000), (2, "http://b/", "y")], PAGES).coalesce(1), f"file://{tmp_path}/w")
    import veilspark.llm.warc as w

    r = WarcReader({"path": f"{tmp_path}/w"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(r.pushFilters([EqualTo(("target_uri",), "http://b/"), GreaterThan(("position",), 3)])) == [GreaterThan(("position",), 3)]
    seen = []
    monkeypatch.setattr(w, "digest", lambda b: seen.append(len(b)) or digest(b))
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert [x["target_uri"] for x in rows] == ["http://b/"] and seen == [1]
    plan = read_archive(spark, f"file://{tmp_path}/w").filter("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # the source does it


def test_other_writers_files(spark, tmp_path):
    row = {"record_id": "<a>", "record_type": "response", "target_uri": "http://x/", "payload_digest": digest(b"hello"), "refers_to": None, "payload": b"hello"}
    (tmp_path / "plain.warc").write_bytes(record(row) + b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + record(row))
    (tmp_path / "zipped.warc.gz").write_bytes(gzip.compress(record(row)) + gzip.compress(record(row)))
    r = read_archive(spark, f"file://{tmp_path}")
    assert r.filter("record_type = 'response'").count() == 4 and {bytes(x["payload"]) for x in r.filter("record_type = 'response'").collect()} == {b"hello"}
    assert bytes(r.filter("record_type = 'warcinfo'").first()["payload"]) == b"abcd"
    (tmp_path / "bad.warc").write_bytes(record(row | {"payload": b"hullo"}))
    with pytest.raises(Exception, match="digest"):
        read_archive(spark, f"file://{tmp_path}").select(F.sum(F.length("payload"))).collect()


def test_small_files_share_a_partition_and_empty_tables(spark, tmp_path):
    archive(spark.createDataFrame(ROWS, PAGES), f"file://{tmp_path}/w")
    archive(spark.createDataFrame(ROWS, PAGES), f"file://{tmp_path}/w")  # appended
    assert read_archive(spark, f"file://{tmp_path}/w").count() == 2 * len(ROWS)
    assert len(WarcReader({"path": f"{tmp_path}/w"}).partitions()) == 1
    assert len(WarcReader({"path": f"{tmp_path}/w", "maxPartitionBytes": "1"}).partitions()) > 1
    archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none")
    assert spark.read.format(FORMAT).load(f"file://{tmp_path}/none").count() == 0
