import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.llm import mpegts as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1200), st.integers(1, 500))
def test_round_trip(payload, unit):
    s = M.mux(payload, unit)
    d = M.demux(s)
    assert b"".join(u.data for u in d.units) == payload and not d.continuity_errors and len(s) % 188 == 0


@pytest.mark.parametrize("n", [0, 1, 161, 162, 163, 345, 346, 347, 8257, 8258, 8259, 70_000, 1_000_000])
def test_lengths_at_packet_edges(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    d = M.demux(M.mux(payload))
    assert b"".join(u.data for u in d.units) == payload
    assert [u.pts for u in d.units] == [k * M.TICKS for k in range(len(d.units))]
    assert [u.random_access for u in d.units] == [k % M.RANDOM_ACCESS == 0 for k in range(len(d.units))]
    assert d.programs == {1: M.MAP_PID} and d.types == {M.DATA_PID: M.STREAM_TYPE}


def test_lost_repeated_and_damaged_packets():
    s = M.mux(bytes(3000))
    parts = [s[i : i + 188] for i in range(0, len(s), 188)]
    assert M.demux(b"".join(parts[:5] + parts[6:])).continuity_errors == 1
    again = M.demux(b"".join(parts[:5] + parts[4:5] + parts[5:]))
    assert (again.repeated, again.continuity_errors, sum(len(u.data) for u in again.units)) == (1, 0, 3000)
    bad = bytearray(s)
    bad[12] ^= 1
    for wrong in (bytes(bad), s[1:] + b"x", s[:-1]):
        with pytest.raises(ValueError):
            M.demux(wrong)
    assert M.demux(b"").units == []
    assert M.section_crc(b"123456789") == 0x0376E6E7


def test_frames(spark):
    df = spark.createDataFrame([(1, "héllo"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in M.digests(df).collect()}
    assert out[1].n_bytes == 6 and out[1].payload_bytes == 64 and out[2].n_bytes == 0 and out[2].payload_bytes == 64
    payload = "héllo".encode().ljust(64, b"\0")
    assert out[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[1].tail_crc32 == zlib.crc32(payload)
    assert out[2][1:] == out[3][1:]
    media = M.store(df.selectExpr("doc_id", "cast(text as binary) as b", "1 as media"), "b")
    back = {r.doc_id: r for r in M.read(media).collect()}
    assert bytes(back[1].payload) == "héllo".encode() and back[1].units[0].length == 6 and bytes(back[2].payload) == b"" and back[3].units == []
    assert M.digests(df.where("false")).count() == 0


def test_query(spark, data):
    from rankweave.llm.queries import op7_mpegts

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in op7_mpegts(spark, data).collect():
        p = M.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest())
        assert r.media_sha256 == hashlib.sha256(M.mux(p)).hexdigest()
