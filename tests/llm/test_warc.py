import json
import time

import pytest

from rankweave.llm import warc

HTML = "<title>A &amp; B</title><p>One<br>two</p><a href='/x?a=1&amp;b=2'>three</a><script>no()</script><img src=y.png>"


def test_records_round_trip():
    made = warc.write_record([("WARC-Type", "resource"), ("X", "a\r\nb")], b"body\r\n\r\nmore")
    assert list(warc.read_records(made + made)) == [([("WARC-Type", "resource"), ("X", "a b")], b"body\r\n\r\nmore")] * 2
    assert list(warc.read_records(b"")) == []
    folded = b"WARC/1.0\r\nX: a\r\n b\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    assert next(warc.read_records(folded)) == ([("X", "a b")], b"z")
    for bad in (b"nothing", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx", b"WARC/1.0\r\nX: y\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))


def test_derivatives_keep_what_identifies_the_source():
    source = warc.response("7", "http://h/p", HTML)
    (headers, block), = warc.read_records(source)
    by = dict(headers)
    d = warc.derivatives(source)
    assert d["problem"] is None and d["refers_to"] == by["WARC-Record-ID"]
    (meta, about), = warc.read_records(d["metadata"])
    (conv, plain), = warc.read_records(d["conversion"])
    for h in (dict(meta), dict(conv)):
        assert h["WARC-Refers-To"] == by["WARC-Record-ID"] and h["WARC-Target-URI"] == "http://h/p" and h["WARC-Date"] == by["WARC-Date"]
    assert dict(conv)["WARC-Source-Payload-Digest"] == by["WARC-Payload-Digest"] and dict(conv)["WARC-Concurrent-To"] == d["metadata_id"]
    assert dict(conv)["WARC-Block-Digest"] == warc.digest(plain) and plain.decode() == d["text"] == "A & B\nOne\ntwo\nthree"
    told = json.loads(about)
    assert told["source"]["headers"] == by and told["html"]["title"] == "A & B"
    assert told["html"]["links"] == [{"path": "A@/href", "url": "/x?a=1&b=2"}, {"path": "IMG@/src", "url": "y.png"}]
    assert warc.derivatives(source) == d


def test_repeated_headers_are_all_kept():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nX: y\r\n\r\n<a title='>' href='/q'>z</a> 1 <b"
    d = warc.derivatives(warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Protocol", "h2"), ("WARC-Protocol", "tls")], block))
    about = json.loads(next(warc.read_records(d["metadata"]))[1])
    assert about["http"]["headers"] == {"Set-Cookie": ["a", "b"], "X": "y"} and about["source"]["headers"]["WARC-Protocol"] == ["h2", "tls"]
    assert about["html"]["links"] == [{"path": "A@/href", "url": "/q"}]


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<p", "<title>", '<a href="', "<script>", "</p", "<a '>"])
def test_time_grows_with_the_page_only(piece):
    began = time.process_time()
    warc.plain_text(piece * 60_000)
    warc.links(piece * 60_000)
    warc.derivatives(warc.response("1", None, piece * 20_000))
    assert time.process_time() - began < 5


def test_what_has_no_derivative():
    source = warc.response("7", None, None)
    assert warc.derivatives(source)["text"] == ""
    assert warc.derivatives(None)["problem"] and warc.derivatives(b"x")["problem"]
    assert "digest" in warc.derivatives(source.replace(b"HTTP/1.1 200 OK", b"HTTP/1.1 404 No"))["problem"]
    assert warc.derivatives(warc.write_record([("WARC-Type", "request"), ("WARC-Record-ID", "<a>")], b""))["problem"] == "not a response"


def test_frames_and_archives(spark):
    df = spark.createDataFrame([(1, "http://a/", HTML), (2, None, None), (2, None, None), (3, "http://c/", "<p>" + "x" * 300_000)], "page_id long, url string, html string").withColumnRenamed("url", "url")
    made = warc.responses(df)
    out = warc.derive(made)
    assert out.where("problem is not null").count() == 0 and out.count() == 4
    files = warc.archives(out)
    assert sum(r.n_records for r in files.collect()) == 8
    back = warc.scan(files)
    assert {tuple(r) for r in back.groupBy("warc_type").count().collect()} == {("metadata", 4), ("conversion", 4)}
    assert {bytes(r.record) for r in back.where("warc_type = 'metadata'").collect()} == {bytes(r.metadata) for r in out.collect()}
    assert warc.derive(warc.scan(warc.archives(made, ("record",)))).where("problem is null").count() == 4
    assert warc.build(df.where("false")).count() == 0
    clash = warc.build(df.selectExpr("page_id", "url", "html", "1 AS text", "2 AS n_links"))
    assert clash.columns.count("text") == 1 and clash.count() == 4


def test_damaged_archives_are_told(spark):
    one = warc.response("1", "http://a/", HTML)
    import gzip

    rows = [(one + b"rubbish",), (gzip.compress(one)[:-20],), (b"\x1f\x8bno",), (None,), (one,)]
    out = warc.scan(spark.createDataFrame(rows, "content binary")).collect()
    assert sum(r.record == one for r in out) == 2 and sum(r.problem is not None for r in out) == 3 and len(out) == 5


def test_query(spark, data):
    from rankweave.llm.queries import op5_warc

    out = op5_warc(spark, data)
    assert out.count() == spark.read.parquet(f"{data}/pages.parquet").count() and out.where("problem is not null or n_chars = 0").count() == 0
    assert out.select("metadata_id").distinct().count() == out.count()
