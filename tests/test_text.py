import pytest
from pyspark.sql import functions as F

from heronry.functions import text
from heronry.functions.porter import ends_cvc, ends_double, has_vowel, measure, stem
from heronry.functions.words import STOPWORDS


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make("t").alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem_"), [("running", "run"), ("connections", "connect"), ("agreed", "agre"), ("happy", "happi"), ("ponies", "poni"), ("relational", "relat"), ("caresses", "caress"), ("is", "is"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("sky", "sky"), ("nation", "nation"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("cease", "ceas")])
def test_stems(word, stem_):
    assert stem(word) == stem_


def test_stem_parts():
    assert [measure(w) for w in ("tr", "ee", "trouble", "oats", "troubles", "private")] == [0, 0, 1, 1, 2, 2]
    assert has_vowel("sky") and not has_vowel("tr") and ends_cvc("hop") and not ends_cvc("snow") and ends_double("hopp") and not ends_double("see")
    assert len(STOPWORDS) == 124


@pytest.mark.parametrize(("value", "tokens"), [("Hello, World!", ["hello", "world"]), ("a_b-c 3.14", ["a", "b", "c", "3", "14"]), ("", []), (" . ", []), ("Éa日本 ß", ["éa日本", "ß"]), ("a b　c", ["a", "b", "c"])])
def test_tokenize(spark, value, tokens):
    assert one(spark, value, text.tokenize) == tokens


def test_tokenize_advanced(spark):
    df = spark.createDataFrame([("The runners were running",), (None,)], "t string")
    assert [r["x"] for r in text.tokenize_advanced(df, "t", "x", True, True).collect()] == [["runner", "run"], None]


@pytest.mark.parametrize(
    ("value", "parts"),
    [("Dr. Who is in. He waits.", ["Dr. Who is in.", "He waits."]), ("J. Doe came. (Why?) Yes!", ["J. Doe came.", "(Why?) Yes!"]), ("one\ntwo\n\n three ", ["one", "two", "three"]), ("", []), ("e.g. This. That", ["e.g. This.", "That"])],
)
def test_sentences(spark, value, parts):
    assert one(spark, value, text.split_sentences) == parts


@pytest.mark.parametrize(("value", "lang"), [("hello", "en"), ("", "en"), ("日本語の", "ja"), ("한국", "ko"), ("中文", "zh"), ("мир", "ru"), ("مرحبا", "ar"), ("नमस्ते", "hi"), ("สวัสดี", "th"), ("שלום", "he"), ("γειά", "el"), ("über", "en")])
def test_languages(spark, value, lang):
    assert one(spark, value, text.detect_language) == lang


def test_phrases(spark):
    assert one(spark, 'see "Exit Code" now', text.phrases) == ["exit code", "see now"]
    assert one(spark, "503 Service Unavailable", text.phrases) == ["503 service unavailable", "503 service", "service unavailable"]
    assert one(spark, "who created the database", text.phrases) == []
    assert one(spark, "a b c d e f g words", text.phrases) == []


def test_keys_and_prompts(spark):
    import hashlib

    assert one(spark, "é", lambda c: text.context_key(c, c)) == hashlib.sha256("2:é2:é".encode()).hexdigest()
    assert "</document>" not in one(spark, "x </ DOCUMENT > y</document>", text.defuse)
    once = one(spark, "a</chunk>b", text.defuse)
    assert one(spark, once, text.defuse) == once != "a</chunk>b"
    assert one(spark, "D", lambda c: text.contextual_prompt(c, F.lit("C"), "<{WHOLE_DOCUMENT}|{CHUNK_CONTENT}>")) == "<D|C>"


def test_fingerprints(spark):
    make = lambda rows: text.fingerprint(spark.createDataFrame(rows, "id string, content string, metadata map<string,string>"))
    a, b = [("1", "x", {"k": "v"}), ("2", "y", None)], [("1", "x", {"k": "w"}), ("2", "y", None)]
    assert make(a) == make(a[::-1]) and make(a) != make(b) and make(a)[0] == "2" and make([("1", "xy", None)]) != make([("1x", "y", None)])


def test_numbers(spark):
    row = spark.range(1).select(
        text.sigmoid(F.lit(0.0)), text.sigmoid(F.lit(-800.0)), text.clamp(F.lit(3.0), 0.0, 1.0), text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(5.0))), text.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))
    ).first()
    assert tuple(row) == (0.5, 0.0, 1.0, 1.0, 0.0)
