from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from utterance_guard.operators import curate, metrics, review
from utterance_guard.sources.contract import LABELLED, SchemaMismatch, check_schema


def labelled(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, text string, label int")


def test_profile_and_cleaning(spark):
    df = labelled(spark, [(1, "t", 0), (2, "t", 1), (3, " ", 0), (4, None, 1), (5, "u", None)])
    assert curate.profile(df).first().asDict() == {
        "n_rows": 5, "n_empty_text": 2, "n_complete": 3, "n_distinct": 2, "n_removed": 1,
    }
    kept = {r["row_id"]: r["label"] for r in curate.clean_labelled(df).collect()}
    assert kept == {1: 0, 3: 0}


def test_augment(spark):
    df = labelled(spark, [(1, "a.", 1), (2, "a!", 0), (3, "b", 0), (4, "c.", 1), (5, "c", 0)])
    rows = curate.augment(df).collect()
    assert [(r["text"], r["label"], r["confidence"], r["needs_review"]) for r in rows] == [
        ("a", 1, 1.0, False)
    ]
    assert curate.training_union(df, curate.augment(df)).count() == 6


def test_top_duplicates_with_ties(spark):
    texts = ["z"] * 3 + ["b", "b", "a", "a", "c", "c", "single"]
    df = labelled(spark, [(i, x, 0) for i, x in enumerate(texts)])
    assert [(r["text"], r["n"]) for r in curate.top_duplicates(df, 3).collect()] == [
        ("z", 3), ("a", 2), ("b", 2),
    ]


@pytest.mark.parametrize("n0, n1", [(40, 7), (1, 1), (100, 3)])
def test_exact_split_against_sorting(spark, n0, n1):
    rows = [(i, "same", int(i >= n0)) for i in range(n0 + n1)]
    wanted = set()
    for label, n in ((0, n0), (1, n1)):
        ids = [r[0] for r in rows if r[2] == label]
        ids.sort(key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        wanted |= set(ids[: (15 * n + 50) // 100])
    for prefix in (1, 4):
        out = curate.split_exact(labelled(spark, rows), 42, prefix=prefix).collect()
        assert {r["row_id"] for r in out if r["side"] == "eval"} == wanted
        assert len(out) == n0 + n1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b.", "b", "c!", "", "日本。"]), min_size=1, max_size=12))
def test_properties(spark, texts):
    df = labelled(spark, [(i, t, i % 2) for i, t in enumerate(texts)])
    once = curate.dedupe_first(df)
    assert sorted(once.collect()) == sorted(curate.dedupe_first(once).collect())
    assert once.count() == len(set(texts))
    assert not {r["text"] for r in curate.augment(df).collect()} & set(texts)
    sides = {}
    for r in curate.split_hash(df, 1, 50).collect():
        assert sides.setdefault(r["text"], r["side"]) == r["side"]


def test_leakage(spark):
    train = labelled(spark, [(1, "Foo!", 0), (2, "x", 0)])
    held = labelled(spark, [(7, "foo", 1), (8, "x", 1), (9, "y", 0)])
    ids = lambda df: sorted(r["row_id"] for r in df.collect())
    assert ids(curate.leakage(held, train)) == [8]
    assert ids(curate.leakage(held, train, loose=True)) == [7, 8]
    assert ids(curate.remove_leakage(held, train)) == [7, 9]


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a", "x")], "row_id bigint, text string, label string")
    with pytest.raises(SchemaMismatch, match="label should be int"):
        check_schema(df, LABELLED)
    with pytest.raises(SchemaMismatch, match="missing: label"):
        check_schema(df.drop("label"), LABELLED)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "expected_label int, predicted int")
    row = metrics.binary_metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_seed_summary_uses_population_deviation(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0, 1.0), (2, 3.0, 3.0, 3.0, 3.0)],
        "seed int, accuracy double, precision double, recall double, f1 double",
    )
    assert {r["std"] for r in metrics.seed_summary(df).collect()} == {1.0}


@pytest.mark.parametrize(
    "scores, best", [([0.1, 0.3, 0.2, 0.3, 0.9], 2), ([0.1, 0.0, 0.2, 0.1, 0.1, 1.0], 3), ([0.5], 1)]
)
def test_best_candidate_stops_waiting(spark, scores, best):
    df = spark.createDataFrame(list(enumerate(scores, 1)), "step int, f1 double")
    assert metrics.best_candidate(df).first()["step"] == best


def test_class_weights(spark):
    df = labelled(spark, [(i, "x", int(i == 0)) for i in range(4)])
    got = {r["label"]: r["weight"] for r in metrics.class_weights(df).collect()}
    assert got == {0: 4 / 6, 1: 2.0}
    assert {r["weight"] for r in metrics.class_weights(df, balanced=False).collect()} == {1.0}


def test_review_queue_ready_at(spark):
    row = "row_id bigint, text string, label string, confidence double, needs_review boolean"
    flagged = spark.createDataFrame([(i, "t", "l", 0.6, True) for i in range(19)], row)
    assert not review.review_queue(flagged, flagged.limit(0)).first()["ready"]
    queue = review.review_queue(flagged, flagged.limit(1))
    assert queue.count() == 20 and queue.first()["ready"]
