from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from utterance_guard.functions import text as t
from utterance_guard.functions.probability import argmax, label_id, probability_map, softmax

SAMPLES = ["ＦＯＯ bar", "ｱﾊﾞ ﾊﾟ", "é", "É", "ΣΑΣ", "㍿①", "a*b", "", "日本語", "ﬁ"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_agrees_with_unicode_and_with_arrow(spark):
    rows = spark.createDataFrame([(s,) for s in [*SAMPLES, None]], "s string")
    out = rows.select("s", t.normalize("s").alias("n"), t.normalize_arrow("s").alias("a"))
    for r in out.collect():
        wanted = None if r["s"] is None else unicodedata.normalize("NFKC", r["s"]).lower()
        assert r["n"] == wanted and r["a"] == wanted


def test_blanks_are_those_of_python():
    assert set(t.BLANKS) == {chr(c) for c in range(0x11000) if chr(c).isspace()}


@pytest.mark.parametrize("s", ["　a　", "   b\tc \n", " ", "", "x"])
def test_strip(spark, s):
    assert one(spark, t.strip(F.lit(s))) == s.strip()


def test_strip_punctuation(spark):
    assert one(spark, t.strip_punctuation(F.lit(" a、b。！？,.!? c; "))) == "ab c;"


def test_keywords_respect_case_and_are_complete(spark):
    assert (len(t.KEYWORDS), len(set(t.KEYWORDS))) == (50, 37)
    assert one(spark, t.keyword_hit(F.lit("xfoox"), ["foo"])) is True
    assert one(spark, t.keyword_hit(F.lit("FOO"), ["foo"])) is False
    assert one(spark, t.keyword_hit(F.lit("本当に無駄だ"))) is True


@pytest.mark.parametrize(
    "value, flagged", [(0.5499, False), (0.55, True), (0.70, True), (0.70004, False)]
)
def test_review_band(spark, value, flagged):
    assert one(spark, t.needs_review(F.lit(value))) is flagged


def test_tokens(spark):
    assert one(spark, t.tokens(F.lit("the é-cat 7x"))) == ["the", "é", "cat", "x"]
    assert one(spark, t.tokens(F.lit("君 太った"), "bigram")) == ["君太", "太っ", "った"]
    assert one(spark, t.tokens(F.lit("君"), "bigram")) == ["君"]
    assert one(spark, t.tokens(F.lit(None).cast("string"))) == []


def test_truncation_counts_special_tokens(spark):
    kept = one(spark, t.truncate_tokens(F.array(*map(F.lit, "abcde")), 4))
    assert kept == ["[CLS]", "a", "b", "[SEP]"]


def test_softmax_and_argmax(spark):
    p = one(spark, softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]
    assert one(spark, argmax(F.array(F.lit(0.5), F.lit(0.5)))) == 0
    assert one(spark, label_id(F.lit(t.HARASSMENT_LABEL))) == 1
    assert one(spark, label_id(F.lit("?"))) is None
    assert one(spark, probability_map(F.array(F.lit(0.25), F.lit(0.75)))) == {
        t.NONE_LABEL: 0.25,
        t.HARASSMENT_LABEL: 0.75,
    }
