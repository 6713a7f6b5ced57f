import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.llm import bpe_dropout as B

tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return B.MergeModel(PATH)


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


ODD = ["", " ", "  two  spaces ", "a\nb\n\n c", "é日本\t€ 😀", "x" * 300, "the " * 5 + "   " * 7, "\n", "abc" * 40, "\x00\x01", "don't"]


def test_without_dropout_as_the_library(model, library):
    got = B.DropoutEncoder(model, 0, 0.0).encode(ODD)
    assert [ids(g) for g in got] == [library.encode(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5), st.integers(0, 3), st.sampled_from([0.0, 0.1, 0.9, 1.0]))
def test_round_trip(texts, seed, rate):
    encoder = B.DropoutEncoder(_MODEL, seed, rate)
    for t, g in zip(texts, encoder.encode(texts), strict=True):
        assert _MODEL.decode(ids(g)) == t


_MODEL = B.MergeModel(PATH)


def test_side_by_side_equals_the_agenda(model):
    words = sorted({w for t in [*ODD, "The quick brown foxes jumped over lazily sleeping dogs", "Straßenbahnhaltestelle internationalisation"] for w in B._WORDS.findall(" " + t) if len(w) < B.LONG})
    for rate in (0.0, 0.1, 0.5, 0.95):
        keys = np.array([B._word_key(w, 5, 2) for w in words], np.uint64)
        got = model.segment([w.replace(" ", B.SPACE) for w in words], keys, rate)
        assert [ids(g) for g in got] == [model.agenda(w.replace(" ", B.SPACE), int(k), rate) for w, k in zip(words, keys, strict=True)]


def test_seeds_vary_and_repeat(model):
    text = "internationalisation of the unbelievable segmentation " * 20
    a, b, c = (B.DropoutEncoder(model, s, 0.2).encode([text])[0] for s in (1, 1, 2))
    assert a == b != c
    assert len(a) > len(B.DropoutEncoder(model, 1, 0.0).encode([text])[0])
    single = B.DropoutEncoder(model, 1, 1.0).encode(["ab cd"])[0]
    assert ids(single) == [model.chars[ord(c)] for c in "▁ab▁cd"]


def test_each_occurrence_is_drawn_on_its_own(model):
    encoder, end = B.DropoutEncoder(model, 1, 0.1), model.byte_ids[ord("\n")]
    word = "internationalisation"
    across = {tuple(ids(g)[: ids(g).index(end)]) for g in encoder.encode([f"{word}\n{i}" for i in range(400)])}
    within, now = set(), []
    for i in ids(encoder.encode([f"{word}\n" * 400])[0]):
        if i == end:
            within.add(tuple(now))
            now = []
        else:
            now.append(i)
    assert len(across) > 20 and len(within) > 20
    alone = [encoder.encode([t])[0] for t in ODD]
    assert alone == encoder.encode(ODD) == B.DropoutEncoder(model, 1, 0.1).encode(ODD)


def test_every_occurrence_equals_its_own_agenda(model, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 40)  # words are forgotten and learned again on the way
    texts = ["the internationalisation of the segmentation, of the 日本 Straßenbahn " * 9, "the the the", "", " ", "x" * 60 + " the a▁b ▁ the", "word" * 7 + " " + "z" * 47] * 2
    for rate in (0.05, 0.3, 0.95):
        for seed in (1, 2):
            encoder = B.DropoutEncoder(model, seed, rate)
            for some in (texts[:3], texts):
                for t, got in zip(some, encoder.encode(some), strict=True):
                    of_text, want = np.array([B._word_key(t, seed, 0)], np.uint64), []
                    for k, w in enumerate(encoder._words(t)):
                        key = B._hash(of_text + np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        want += model._bytes_of(w) if w == B.SPACE else model.agenda(w.replace(" ", B.SPACE), int(key[0]), rate)
                    assert ids(got) == want


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello  world", "x"), (2, None, "y"), (3, "", None), (3, "", None), (4, "a▁b", "z")], "doc_id long, text string, ids string")
    out = B.decode(B.encode(df, PATH, seed=3, rate=0.3), PATH)
    assert {(r.doc_id, r.text, r.decoded) for r in out.collect()} == {(1, "Hello  world", "Hello  world"), (2, None, None), (3, "", ""), (4, "a▁b", "a▁b")}
    d = B.digests(df, PATH, seed=3, rate=0.3)
    assert d.where("not lossless").count() == 0 and "text" not in d.columns
    assert B.digests(df.where("false"), PATH).count() == 0


def test_query(spark, data):
    from rankweave.llm.queries import op3_bpe_dropout

    out = op3_bpe_dropout(spark, data)
    assert out.count() == 200 and out.where("not lossless").count() == 0
