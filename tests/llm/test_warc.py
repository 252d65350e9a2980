import gzip
import hashlib
import json
import random

from pyspark.sql.datasource import EqualTo

from orelode.llm import warc

BIG = "<p>" + "x" * 1200


def pages():
    rows = [(1, "http://a/", BIG), (5, "http://b/", BIG), (3, "http://c/", BIG), (2, "http://d/", "small"), (4, None, "small"), (6, "u\r\nWARC-Type: x", None), (7, "http://e/", "é" * 600 + "\r\n\r\nWARC/1.1\r\n"), (8, "", "")]
    rows += [(None, "http://n/", BIG), (9, "http://f/", "z" * 999), (10, "http://g/", "z" * 999), (20, "h", "y" * 1000), (20, "h", "y" * 1000)]
    return [(i, u, h, "clash", "clash") for i, u, h in rows]


def plain(rows):
    groups = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            groups[b] = max(groups.get(b, i), i)
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and groups[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", groups[b] if revisit else None))
    return out


def test_round_trip(spark, tables):
    got = warc.op7_warc(spark, tables(pages=pages())).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(pages())))


def test_payloads_and_pushdown(spark, tables, tmp_path):
    df = spark.read.parquet(tables(pages=pages()) + "/pages.parquet")
    warc.write_archives(df, f"{tmp_path}/w")
    whole = warc.read_archives(spark, f"{tmp_path}/w", payload="true")
    html = {(r["page_id"], r["target_uri"]): bytes(r["payload"]) for r in whole.where("record_type = 'response' and page_id = 7").collect()}
    assert html == {(7, "http://e/"): ("é" * 600 + "\r\n\r\nWARC/1.1\r\n").encode()}
    reader = warc.WarcReader(f"{tmp_path}/w", {})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("page_id",), (1, 5)), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan"]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["page_id"], r["record_type"], r["payload"]) for r in rows] == [(1, "revisit", None)]
    kinds = {r["record_type"]: r["count"] for r in warc.read_archives(spark, f"{tmp_path}/w", ("warcinfo", "response", "revisit")).groupBy("record_type").count().collect()}
    assert kinds["warcinfo"] >= 1 and kinds["revisit"] == 3


def test_only_named_archives_are_read(spark, tables, tmp_path):
    df = spark.read.parquet(tables(pages=pages()) + "/pages.parquet")
    warc.write_archives(df, f"{tmp_path}/w")
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(gzip.compress(warc.page_record(99, "http://lost/", "response", None, "00" * 20, b"")))
    assert warc.read_archives(spark, f"{tmp_path}/w").where("page_id = 99").count() == 0


def test_refused_records_are_not_inflated(tmp_path, monkeypatch):
    """Every record is a member that plain gzip reads, too; a refused one costs its header alone."""
    records = [warc.page_record(k, f"http://{k}/", "response", None, "00" * 20, random.Random(k).randbytes(300_000)) for k in range(20)]
    at, cuts = 0, [0]
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for k, r in enumerate(records):
            at += f.write(warc.member(r, 1))
            cuts += [at] if k in (6, 13) else []
    assert gzip.decompress((tmp_path / "a.warc.gz").read_bytes()) == b"".join(records)
    (tmp_path / "manifest-1.json").write_text(json.dumps({"a.warc.gz": [*cuts, at]}))
    reader = warc.WarcReader(str(tmp_path), {"bytesPerTask": "1000", "payload": "true"})
    assert len(reader.partitions()) == 3
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["page_id"] for r in got] == list(range(20)) and got[11]["payload"] == random.Random(11).randbytes(300_000)
    fed = []
    get = warc.Ahead.get
    monkeypatch.setattr(warc.Ahead, "get", lambda self, at, n: fed.append(len(out := get(self, at, n))) or out)
    reader.pushFilters_done = list(reader.pushFilters([EqualTo(("page_id",), 15)]))
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["page_id"] for r in got] == [15] and sum(fed) < 20 * 70_000 + 320_000


def test_hot_payloads_are_broadcast(spark, tables):
    rows = [(k, "http://a/", BIG, "", "") for k in range(60)] + [(100 + k, "http://b/", "q" * (1000 + k % 25), "", "") for k in range(50)] + [(None, "n", BIG, "", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, record_type string")
    for most in (1, 3, 1000):
        got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.plan_records(df, shared_rows=most).collect()]
        assert sorted(map(str, got)) == sorted(str((i, kind, to)) for i, _, _, kind, to in plain(rows))


def test_against_sql(spark, tables):
    """The registered SQL on planted equal payloads."""
    import duckdb

    rows = [(k, f"http://{k % 7}/", None if k % 11 == 0 else chr(97 + k % 5) * (900 + 50 * (k % 4)), "", "") for k in range(200)]
    at = tables(pages=rows)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{at}/pages.parquet/*.parquet'")
    got = sorted(map(str, map(tuple, warc.op7_warc(spark, at).collect())))
    assert got == sorted(map(str, con.execute(warc.ORACLE).fetchall())) and sum("revisit" in g for g in got) > 50


def test_foreign_archive(spark, tmp_path):
    (tmp_path / "w").mkdir()
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    (tmp_path / "w" / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body) * 2)
    got = warc.read_archives(spark, f"{tmp_path}/w", payload="true").collect()
    assert [(r["page_id"], r["target_uri"], r["payload_bytes"], bytes(r["payload"])) for r in got] == [(None, "http://x/", 5, b"hello")] * 2


def test_empty(spark, tables):
    assert warc.op7_warc(spark, tables(pages=[])).count() == 0
