from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterance_guard.functions.text import HARASSMENT_LABEL, NONE_LABEL
from utterance_guard.operators.cascade import moderate
from utterance_guard.operators.lexicon import blocklist
from utterance_guard.operators.scoring import (
    OutsideScorer,
    WeightScorer,
    ensemble_of_rows,
    ensemble_result,
    member_rows,
)
from utterance_guard.sources.files import PHRASE, empty_lexicon, make_lexicon

TEXTS = [
    "ＦＯＯ bar", "foobar", "foo bar", "Kill  YOU!", "skill your", None, "", "　", "plain",
    "we kill you, foo", "ab", "long tail abcdefghijklmnopqrstuvwxyz0123456789 end",
    "bad bad good", "good",
]


def utterances(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")


def lexicons(spark):
    words = ["foo", "foobar", "# note", "", "b", "abcdefghijklmnopqrstuvwxyz0123456789"]
    return make_lexicon(spark, words, "list_a").unionByName(
        make_lexicon(spark, ["kill you"], "list_b", PHRASE)
    )


def scorer(spark, **options):
    rows = [
        (s, token, Decimal(w))
        for s, token, w in [
            (1, "bad", "1.5"), (2, "bad", "1.0"), (3, "bad", "0.5"), (1, "good", "-2"),
        ]
    ]
    table = spark.createDataFrame(rows, "member int, token string, w decimal(18,4)")
    bias = {1: Decimal("-0.5"), 2: Decimal("-0.1"), 3: Decimal("-0.2")}
    return WeightScorer(table, bias, **options)


def found(df):
    return {
        r["row_id"]: (r["matched"], r["matched_words"], r["matched_sources"]) for r in df.collect()
    }


def test_lexicon_rules(spark):
    hits = found(blocklist(utterances(spark), lexicons(spark)))
    assert hits[0] == (True, ["foo", "b"], ["list_a", "list_a"])
    assert hits[1][1] == ["foo", "foobar", "b"]
    assert hits[2][1] == ["foo", "b"]
    assert hits[3] == (True, ["[phrase]"], ["list_b"])
    assert hits[4][0] is False and hits[5] == (False, [], [])
    assert hits[9] == (True, ["foo", "[phrase]"], ["list_a", "list_b"])


@pytest.mark.parametrize("can_broadcast", [True, False])
def test_joined_lexicon_gives_the_same_hits(spark, can_broadcast):
    inline = found(blocklist(utterances(spark), lexicons(spark)))
    joined = blocklist(
        utterances(spark), lexicons(spark), inline_limit=0, can_broadcast=can_broadcast
    )
    assert found(joined) == inline


def test_empty_lexicon(spark):
    assert not any(m for m, _, _ in found(blocklist(utterances(spark), empty_lexicon(spark))).values())


@pytest.mark.parametrize("can_broadcast", [True, False])
def test_joined_scores_equal_inline_scores(spark, can_broadcast):
    df = utterances(spark)
    inline = scorer(spark).margins(df).collect()
    joined = scorer(spark, inline_tokens=0, can_broadcast=can_broadcast).margins(df).collect()
    assert sorted(map(str, inline)) == sorted(map(str, joined))
    by_id = {r["row_id"]: r["margins"] for r in inline}
    assert by_id[12] == [Decimal("0.5"), Decimal("1.9"), Decimal("0.8")]
    assert by_id[8] == [Decimal("-0.5"), Decimal("-0.1"), Decimal("-0.2")]


def test_batch_verdicts(spark):
    out = {r["row_id"]: r for r in moderate(utterances(spark), lexicons(spark), scorer(spark)).collect()}
    assert len(out) == len(TEXTS)
    hit = out[9]
    assert (hit["label"], hit["confidence"], hit["needs_review"]) == (HARASSMENT_LABEL, 1.0, False)
    assert hit["source"] == "blocklist(list_a,list_b)"
    assert out[13]["label"] == NONE_LABEL and out[13]["source"] == "model_ensemble"


def test_online_verdicts(spark):
    online = moderate(utterances(spark), lexicons(spark), scorer(spark), "online")
    out = {r["row_id"]: r for r in online.collect()}
    for blank in (5, 6, 7):
        assert (out[blank]["reason"], out[blank]["confidence"]) == ("empty_input", 1.0)
        assert out[blank]["is_nondeli"] is False and out[blank]["individual_seeds"] is None
    assert out[0]["is_nondeli"] is True and out[0]["individual_seeds"] is None
    assert [s["seed"] for s in out[8]["individual_seeds"]] == [1, 2, 3]


def _load(seed):
    def load():
        def model(texts):
            assert not any("foo" in t for t in texts)  # settled rows never get here
            return np.array([[0.0, len(t) * 0.1 - seed] for t in texts])

        return model

    return load


def test_outside_model_sees_open_rows_only(spark):
    outside = OutsideScorer({1: _load(1), 2: _load(2)})
    out = {r["row_id"]: r for r in moderate(utterances(spark), lexicons(spark), outside).collect()}
    assert len(out) == len(TEXTS)
    assert out[1]["source"].startswith("blocklist(")
    assert out[13]["label"] == NONE_LABEL


def test_mean_not_vote(spark):
    rows = spark.createDataFrame(
        [(1, s, 1 - p, p) for s, p in ((1, 0.45), (2, 0.45), (3, 0.95))],
        "row_id int, seed int, p0 double, p1 double",
    )
    assert ensemble_of_rows(rows).first()["label"] == HARASSMENT_LABEL


def test_ensemble_result_and_members(spark):
    scored = scorer(spark).score(utterances(spark, ["bad"]))
    result = ensemble_result(scored).first()["result"]
    assert abs(sum(result["probabilities"].values()) - 1) < 1e-12
    assert [m["seed"] for m in result["individual"]] == [1, 2, 3]
    assert member_rows(scored).count() == 3


def test_taken_column_is_refused(spark):
    df = utterances(spark).withColumn("label", F.lit(1))
    with pytest.raises(ValueError, match="label"):
        moderate(df, lexicons(spark), scorer(spark))


def test_no_shuffle_in_the_inline_plan(spark):
    plan = moderate(spark.range(5).selectExpr("id as row_id", "cast(id as string) as text"),
                    lexicons(spark), scorer(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and "Python" not in text
