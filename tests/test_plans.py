"""Plans of registered queries, and what travels past them."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import functions as F

from utterance_guard.functions.text import tokens
from utterance_guard.operators import curate, learn
from utterance_guard.operators.cascade import moderate
from utterance_guard.operators.scoring import (
    ModelScorer, OutsideScorer, WeightScorer, member_rows, score_texts,
)
from utterance_guard.plans import fixed, queries
from utterance_guard.sources.files import make_lexicon, read_eval, read_history
from utterance_guard.streaming import alerts as speech

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def jobs_that_score(spark, monkeypatch, name) -> int:
    """How often a query puts the cascade into a plan."""
    calls = []
    own = queries.verdicts
    monkeypatch.setattr(queries, "verdicts", lambda *a: calls.append(1) or own(*a))
    frame = queries.registered()[name](spark, FOLDER)
    assert "_found" not in plan_of(frame)  # only rows that were written are left in the plan
    return len(calls)


@tables
@pytest.mark.parametrize("name", ["review_queue", "suspect_words", "monthly_review"])
def test_one_cascade(spark, monkeypatch, name):
    assert jobs_that_score(spark, monkeypatch, name) == 1


@tables
def test_exact_split_broadcasts_the_cuts(spark):
    frame = queries.split_exact(spark, FOLDER)
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    final = text.split("Initial Plan")[0]
    assert "SortMergeJoin" not in final and "parquet" not in final.lower()


@tables
def test_verdicts_shuffle_texts_at_most_once(spark):
    """The registered query may spread its input over the cores; the cascade adds nothing."""
    plan = queries.verdicts_batch(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Join" not in plan and "Python" not in plan


def test_bigrams_keep_characters_whole(spark):
    row = spark.createDataFrame([("a😀bc",)], "t string").select(tokens("t", "bigram")).first()
    assert row[0] == ["a😀", "😀b", "bc"]


def test_callers_columns_survive(spark):
    names = ["empty", "settled", "normal_text", "model_text", "phrase_text", "members", "hits",
             "matched", "matched_words", "probabilities", "tokens", "_tokens"]
    df = spark.createDataFrame(
        [(1, "you idiot", *names), (2, None, *names)],
        "row_id long, text string, " + ", ".join(f"{n} string" for n in names),
    )
    models = {42: tiny_model(spark)}
    for scorer in (fixed.scorer(spark), ModelScorer(models)):
        for mode in ("batch", "online"):
            for limit in (0, 128):
                rows = moderate(
                    df, fixed.two_lexicons(spark), scorer, mode, inline_limit=limit
                ).collect()
                assert len(rows) == 2 and all(r[n] == n for r in rows for n in names)


_TINY = {}


def tiny_model(spark):
    if spark not in _TINY:
        rows = [(i, "awful" if i % 2 else "fine", i % 2) for i in range(20)]
        df = spark.createDataFrame(rows, "row_id long, text string, label int")
        _TINY[spark] = learn.fit(learn.with_tokens(df), 42, learn.Settings(rounds=3))
    return _TINY[spark]


def test_copies_have_ids_of_their_own(spark):
    rows = [(i, f"word{i % 9} moron, the loser!", i % 2) for i in range(20)]
    df = curate.clean_labelled(spark.createDataFrame(rows, "row_id long, text string, label int"))
    union = curate.training_union(df, curate.augment(df))
    assert union.count() == union.select("row_id").distinct().count() == 18
    weights = fixed.scorer(spark).weights
    ways = [
        WeightScorer(weights, fixed.BIAS, inline_tokens=n, can_broadcast=b)
        for n, b in ((128, None), (0, True), (0, False))
    ]
    answers = [
        sorted(map(tuple, member_rows(w.score(union)).select("row_id", "seed", "margin").collect()))
        for w in ways
    ]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 54


def test_training_uses_every_row_and_token(spark):
    rows = [(i, f"rare{chr(97 + i % 25)}{chr(97 + i // 25)} common", i % 2) for i in range(50)]
    df = learn.with_tokens(spark.createDataFrame(rows, "row_id long, text string, label int"))
    assert learn.training_rows(df, 1).count() == 50
    exported = learn.export_weights({1: learn.fit(df, 1, learn.Settings(rounds=2))}, df)
    assert exported.weights.count() == 51


def test_evaluation_to_history(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "awful", 1), (2, "fine", 0)], "row_id long, text string, expected_label int"
    )
    models, path = {42: tiny_model(spark)}, str(tmp_path / "history")
    at = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    learn.evaluate_and_record(models, df, path, at, train_rows=df)
    learn.evaluate_and_record(models, df, path, at)
    learn.evaluate_and_record(models, df, path, at, official=False)
    rows = read_history(spark, path).collect()
    assert sorted((r["train_data_size"] or 0, r["n_eval_samples"]) for r in rows) == [(0, 2), (2, 2)]


def test_empty_expected_label_stops(spark, tmp_path):
    (tmp_path / "e.csv").write_text("text,expected_label\na,1\nb,\n")
    with pytest.raises(PySparkException, match="expected_label is empty"):
        read_eval(spark, str(tmp_path / "e.csv")).collect()


def test_outside_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        return lambda texts: np.array([[0.0, float(len(t))] for t in texts])

    scorer = OutsideScorer({7: load})
    df = spark.range(400).repartition(40).select(
        F.col("id").alias("row_id"), F.concat(F.lit("text "), F.col("id")).alias("text")
    )
    out = score_texts(df, scorer)
    assert out.filter("label is not null").count() == 400
    out.agg(F.sum("confidence")).collect()
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads))


def test_outside_model_does_not_see_settled_rows(spark):
    def load():
        def judge(texts):
            assert all("idiot" not in t for t in texts)
            return np.zeros((len(texts), 2))

        return judge

    df = spark.createDataFrame([(1, "you idiot"), (2, "fine"), (3, None)], "row_id long, text string")
    out = moderate(df, fixed.two_lexicons(spark), OutsideScorer({1: load}))
    assert plan_of(out).count("LogicalRDD") + plan_of(out).count("LocalRelation") <= 1
    assert {r["row_id"]: r["source"][:5] for r in out.collect()} == {
        1: "block", 2: "model", 3: "model",
    }


def test_alert_stream_takes_large_lexicons(spark, tmp_path):
    words = [f"bad{i}" for i in range(1000)]
    lexicon = make_lexicon(spark, words, "list_a")
    weights = spark.createDataFrame(
        [(42, f"tok{i}", 0.01 * (i % 7)) for i in range(1000)], "member int, token string, w double"
    )
    scorer = WeightScorer(weights, {42: -0.05})
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at, f"tok{i} bad{i * 3} tok{i + 1}" if i % 2 else f"tok{i}", True, str(i))
            for i in range(60)]
    df = spark.createDataFrame(
        rows, "speaker_id long, ts timestamp, text string, is_final boolean, row_id string"
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = speech.alert_stream(
        stream, lexicon, scorer, out, str(tmp_path / "state"), available_now=True
    )
    query.awaitTermination(120)
    columns = ["row_id", "is_nondeli", "reason", "alert"]
    batch = speech.alerts(df, lexicon, scorer).select(columns)
    assert sorted(spark.read.parquet(out).select(columns).collect()) == sorted(batch.collect())


def test_null_transcript_gives_no_alert(spark):
    df = spark.sql("SELECT cast(null AS boolean) AS keyword, cast(null AS boolean) AS is_nondeli")
    assert speech.with_alert(df).first()["alert"] is False
