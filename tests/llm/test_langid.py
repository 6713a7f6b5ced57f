import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import langid

SAMPLES = {"aa": "the cat and the hat sat on the mat with that bat " * 5, "bb": "le chat et la souris ont bu un peu de lait hier " * 5}


def normalised(text):
    out = ""
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out += c
    return out


def brute(text, sample):
    """Greedy longest matches over the whole text."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = j, n + 1
    return n


@pytest.mark.parametrize(("window", "dense"), [(langid.WINDOW, langid.DENSE), (7, langid.DENSE), (64, 0), (langid.WINDOW, 0)])
def test_phrases_are_greedy_longest_matches(monkeypatch, window, dense):
    monkeypatch.setattr(langid, "WINDOW", window)
    monkeypatch.setattr(langid, "DENSE", dense)
    langid._parsers.cache_clear()
    rng = np.random.default_rng(1)
    many = "".join(chr(0x4E00 + i) for i in rng.integers(0, 300, 2000))  # far more letters than any Latin script
    model = langid.LanguageModel(SAMPLES | {"cc": many, "dd": "aaa b " + "ab" * 40})
    texts = ["", "  ", "the cat", "xyz ß漢字 qq", "Le CHAT, et la!! souris", "a" * 5000, "ab" * 3000, "the mat and " * 900, many[500:1700] + many[:900], "İstanbul ǅ"]
    texts += ["".join(rng.choice(list("the catx et "), 300)) for _ in range(20)]
    count, kept, letters = langid.phrases(texts, model)
    assert model.samples[2] == many
    for k, t in enumerate(texts):
        assert kept[k] == len(normalised(t)) and letters[k] == sum(c.isalpha() for c in t)
        assert [brute(normalised(t), s) for s in model.samples] == count[:, k].tolist()
    langid._parsers.cache_clear()


def test_scripts_with_many_letters_are_told_apart():
    """All letters are told apart, not the most frequent ones only."""
    rng = np.random.default_rng(2)
    one, two = ("".join(chr(b + i) for i in rng.integers(0, 400, 4000)) for b in (0x4E00, 0x6000))
    model = langid.LanguageModel({"aa": SAMPLES["aa"] * 30, "one": one, "two": two})
    assert langid.predict_texts([one[100:160], two[70:90], one[5:8], two[9:11]], model)[0] == ["one", "two", "one", "two"]


def test_a_text_is_predicted_alike_in_any_batch():
    model = langid.LanguageModel(SAMPLES)
    texts = ["le chat et la souris", "the hat that sat", None, "12 !?", "漢字"]
    langs, score, _ = langid.predict_texts(texts, model)
    assert langs[:4] == ["bb", "aa", "und", "und"] and langs[4] in ("aa", "bb")
    assert score[2] == score[3] == 0 and all(0 <= s <= 1 for s in score)
    for i, t in enumerate(texts):
        alone = langid.predict_texts([t], model)
        assert alone[0] == [langs[i]] and alone[1][0] == score[i]


def test_frames_with_nulls_clashing_columns_and_no_rows(spark):
    rows = [(1, "the cat sat on the mat", "aa", 5), (2, None, "bb", 6), (3, "", None, 7), (3, "", None, 7), (None, "le chat et la souris", "bb", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = langid.train(df, F.lit(True))
    out = langid.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits_per_symbol"]
    assert [r.lang_pred for r in out.orderBy(F.col("doc_id").asc_nulls_last()).collect()] == ["aa", "und", "und", "und", "bb"]
    none = langid.train(df.where("false"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, none).collect()} == {("und", 0.0)}
    assert langid.predict(df.where("false"), model).count() == 0
    one = langid.predict(df, langid.LanguageModel({"aa": SAMPLES["aa"]})).where("doc_id = 1").first()
    assert (one.lang_pred, one.score) == ("aa", 1.0)
    assert [r.h for r in df.select(langid.held_out().alias("h")).collect()][-1] is False


def test_every_text_of_a_language_counts_once(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    letterless = [(f"{i} !?", "cc") for i in range(200)]
    for salt in range(4):
        hot = [(f"{w} {salt}", "aa") for w in words for _ in range(300)]
        df = spark.createDataFrame([*hot, *letterless, ("der Hund", "cc"), ("le chat", "bb")], "text string, lang string")
        model = langid.train(df, F.lit(True))
        assert model.languages == ["aa", "bb", "cc"]
        assert all(w in model.samples[0] for w in words)


def test_held_out_accuracy(spark, data):
    from rankweave.llm.queries import op1_language_id

    out = op1_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert out.count() > 20 and right >= 0.95
