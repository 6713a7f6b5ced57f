import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.llm import packing as K

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


ODD = ["", "Hello, World! it's 42 don't", "İSTANBUL ΣΑΣ", "a\x1cb\x85c", "<|endoftext|> hi", "１２ ２", "東京 x", "a_b__c  d e ²³½ ñandú", "x" * 400, "é é", "\t\n", "'s's 'll"]


def test_ids_are_the_librarys(library):
    encoder = K.WordEncoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(ODD)] == [library.encode(t, add_special_tokens=False).ids for t in ODD]
    small = K.WordEncoder(PATH, 5)
    assert small.encode(ODD) == encoder.encode(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_ids_of_any_text(texts):
    got = _ENCODER.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


_ENCODER, _LIBRARY = K.WordEncoder(PATH), tokenizers.Tokenizer.from_file(PATH)


def test_differencing_two_ways():
    at = K.differencing(np.array([8, 7, 6, 5, 4]), 2)
    sums = sorted(np.bincount(at, weights=[8, 7, 6, 5, 4]))
    assert sums == [14, 16]  # the largest differencing result for this list
    assert K.differencing(np.array([], np.int64), 3).tolist() == [] and K.differencing(np.array([5]), 1).tolist() == [0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold_and_are_few(sizes):
    at, k = K.pack_sizes(np.array(sizes), 100)
    load = np.bincount(at, weights=sizes, minlength=k)
    assert load.max() <= 100 and load.sum() == sum(sizes)
    assert k <= 2 * -(-sum(sizes) // 100) + 1


def test_pieces_cover_each_document_once():
    docs = [bytes(4 * n) for n in (1, 2048, 2049, 5000, 3, 700, 700, 12000)]
    rows = list(K.pack_ids(docs, part=300, group_ids=4096))
    for d, raw in enumerate(docs):
        own = sorted((s, n) for x, s, n, _, _ in rows if x == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and sum(n for _, n in own) == len(raw) // 4
    by = {}
    for _, _, n, q, o in rows:
        by.setdefault(q, []).append((o, n))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(pieces)) and sum(n for _, n in pieces) <= 2048


def test_frames(spark, library):
    rows = [(1, "some text here", 1), (2, None, 2), (3, "", 3), (3, "", 3), (None, "word " * 5000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    out = K.pack(df, PATH, with_ids=True).collect()
    whole = {}
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        whole.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    assert [x for _, i in sorted(whole[1]) for x in i] == [*library.encode("some text here", add_special_tokens=False).ids, 1]
    assert whole[2] == [(0, [1])] and whole[3] == [(0, [1])] * 2
    assert sum(len(i) for _, i in whole[None]) == 5001
    assert K.pack(df.where("false"), PATH).count() == 0
    assert sorted(map(tuple, K.pack(df, PATH).collect()), key=str) == sorted(map(tuple, K.pack(df, PATH).collect()), key=str)


def test_query_has_little_padding(spark, data):
    from rankweave.llm.queries import op6_packing

    rows = op6_packing(spark, data).collect()
    ids = sum(r.length for r in rows)
    assert 1 - ids / (2048 * len({r.sequence_id for r in rows})) < 0.05
    assert {r.doc_id: r.doc_tokens for r in rows}.keys() == {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
