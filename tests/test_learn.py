from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from utterance_guard.operators import learn, scoring
from utterance_guard.operators.metrics import binary_metrics
from utterance_guard.operators.scoring import ModelScorer, member_rows, score_members, score_texts
from utterance_guard.sources import files

SETTINGS = learn.Settings()


@pytest.fixture(scope="module")
def labelled(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [
        (i, f"{words[i % 4]} {words[i // 4 % 4]} n{'abcdefghij'[i % 10]} {'awful' if i % 3 == 0 else 'fine'}"
            + " x" * (i // 40), int(i % 3 == 0))
        for i in range(120)
    ]
    return spark.createDataFrame(rows, "row_id bigint, text string, label int").cache()


@pytest.fixture(scope="module")
def models(labelled):
    got, rows = learn.multi_seed(labelled, labelled, seeds=(42, 123), settings=SETTINGS)
    assert [r["seed"] for r in rows.orderBy("seed").collect()] == [42, 123]
    assert min(r["f1"] for r in rows.collect()) > 0.9
    return got


@pytest.mark.parametrize("inline", [0, 10_000])
def test_exported_weights_score_like_the_models(labelled, models, inline):
    exported = learn.export_weights(models, learn.with_tokens(labelled), inline_tokens=inline)
    p1 = F.get("probabilities", F.lit(1)).alias("p")
    a = score_texts(labelled, ModelScorer(models)).select("row_id", p1)
    b = score_texts(labelled, exported).select("row_id", p1.alias("q"))
    worst = a.join(b, "row_id").agg(F.count("*"), F.max(F.abs(F.col("p") - F.col("q")))).first()
    assert worst[0] == 120 and worst[1] < 1e-9


def test_models_survive_saving(spark, labelled, models, tmp_path):
    for seed, model in models.items():
        files.save_model(model, str(tmp_path), seed)
    back = files.load_models(str(tmp_path), tuple(models))
    same = learn.evaluate(back, labelled).first() == learn.evaluate(models, labelled).first()
    assert same


def test_selection_stops_and_keeps_the_first_best(labelled):
    candidates = [learn.Settings(decay=d, rounds=10) for d in (0.01, 0.02, 0.03, 0.04)]
    _, best, scores = learn.select_best(
        learn.clean_labelled(labelled), labelled, 42, candidates, patience=2
    )
    assert best == candidates[scores.index(max(scores))]
    assert len(scores) <= 4


def test_bootstrap_mean_is_one(spark):
    mean = spark.range(20000).select(learn.bootstrap_weight(1, "id").alias("w")).agg(F.avg("w"))
    assert abs(mean.first()[0] - 1) < 0.05


def test_judge_keeps_labels(labelled, models):
    judged = learn.judge(models, labelled)
    assert binary_metrics(judged, "label", "predicted").first()["n"] == 120


def test_hashed_counts_fit_like_tokens(labelled):
    tokenised = learn.with_tokens(labelled)
    counted = learn.with_counts(tokenised, SETTINGS)
    assert "tokens" not in counted.columns
    a, b = (learn.fit(rows, 42, SETTINGS) for rows in (tokenised, counted))
    assert abs(a.stages[-1].intercept - b.stages[-1].intercept) < 1e-9
    assert abs(a.stages[-1].coefficients.toArray() - b.stages[-1].coefficients.toArray()).max() < 1e-9


def test_selection_takes_candidates_of_different_features(labelled):
    candidates = [learn.Settings(features=f, rounds=5) for f in (16, 1 << 18)]
    _, best, scores = learn.select_best(
        learn.clean_labelled(labelled), labelled, 42, candidates, patience=2
    )
    assert best == candidates[scores.index(max(scores))] and len(scores) == 2


def test_members_are_exploded_without_scoring_twice(labelled, models):
    rows = member_rows(score_members(labelled, ModelScorer(models)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "UDF" in line]


def test_exported_weights_know_their_uses(labelled, models, monkeypatch):
    monkeypatch.setattr(scoring, "uses_that_fit", lambda used, uses: 50)
    exported = learn.export_weights(
        models, learn.with_tokens(labelled), inline_tokens=0, can_broadcast=False
    )
    uses = {r["token"]: r["uses"] for r in exported.weights.collect()}
    assert uses["awful"] == 40 and uses["fine"] == 80
    p1 = F.get("probabilities", F.lit(1)).alias("p")
    a = score_texts(labelled, ModelScorer(models)).select("row_id", p1)
    b = score_texts(labelled, exported).select("row_id", p1.alias("q"))
    worst = a.join(b, "row_id").agg(F.count("*"), F.max(F.abs(F.col("p") - F.col("q")))).first()
    assert worst[0] == 120 and worst[1] < 1e-9
