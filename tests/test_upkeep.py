"""The stored training set, endings of wrong rows, and what a fit has left undone."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterance_guard.operators import learn
from utterance_guard.operators.review import chi_squared_tail, mined_endings, new_areas
from utterance_guard.sources.store import merge_texts, read_store

ROWS = "row_id long, text string, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def stored(spark, path):
    rows = read_store(spark, path, frame(spark, []).schema).collect()
    return sorted((r["row_id"], r["text"], r["label"]) for r in rows)


def files(path):
    return {
        f"{folder}/{name}" for folder, _, names in os.walk(path) for name in names
        if name.endswith(".parquet")
    }


def test_merge(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(i, f"text {i % 40}", i % 2) for i in range(60)] + [(90, None, 1), (91, "", 0)]
    assert merge_texts(frame(spark, first), path) == 41
    wanted = [(i, f"text {i}", i % 2) for i in range(40)] + [(91, "", 0)]
    assert stored(spark, path) == sorted(wanted)
    before = files(path)
    assert merge_texts(frame(spark, first), path) == 0  # a repeated merge writes nothing
    assert files(path) == before
    more = [(200, "text 3", 1), (201, "a new one", 1), (202, "a new one", 0)]
    assert merge_texts(frame(spark, more), path) == 1
    assert stored(spark, path) == sorted([*wanted, (201, "a new one", 1)])
    touched = {f.split("prefix=")[1][:2] for f in files(path) ^ before}
    assert len(touched) == 1  # the prefixes that gained nothing are as they were


def test_a_killed_merge_is_completed(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = frame(spark, [(i, f"t{i}", 0) for i in range(50)])
    merge_texts(rows, path)
    lost = sorted(os.listdir(path))[3]
    for f in files(f"{path}/{lost}"):  # as if this prefix had not been moved into place
        os.remove(f)
    left = len(stored(spark, path))
    assert left < 50 and merge_texts(rows, path) == 50 - left
    assert stored(spark, path) == [(i, f"t{i}", 0) for i in range(50)]


def test_nothing_to_store(spark, tmp_path):
    assert merge_texts(frame(spark, []), str(tmp_path / "s")) == 0
    assert stored(spark, str(tmp_path / "s")) == []


def brute_endings(rows, longest=6, minimum=3):
    n, wrong = Counter(), Counter()
    for text, expected, predicted in rows:
        t = (text or "").strip()
        for k in range(1, min(longest, len(t)) + 1):
            n[t[-k:]] += 1
            wrong[t[-k:]] += expected != predicted
    kept = {e: w for e, w in wrong.items() if w >= minimum}
    most = {}
    for e, w in kept.items():
        most[e[1:]] = max(w, most.get(e[1:], 0))
    return {(e, n[e], w) for e, w in kept.items() if most.get(e, 0) < w}


def test_endings(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choices("abü。", k=rng.randrange(0, 9))) + rng.choice(["だよね", "desu", " ", ""]),
             rng.randrange(2), rng.randrange(2)) for _ in range(200)] + [(None, 0, 1), ("", 1, 0)]
    df = spark.createDataFrame(rows, "text string, expected_label int, predicted int")
    found = mined_endings(df).collect()
    assert {(r["ending"], r["n"], r["n_wrong"]) for r in found} == brute_endings(rows)
    assert mined_endings(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(9)
    words = [a + b for a in "abcde" for b in "ghijklmn"]
    rows = []
    for i in range(300):
        label = int(rng.random() < 0.3)
        own = rng.choices(words[:25] if label else words[10:], k=rng.randrange(1, 12))
        rows.append((i, " ".join(own), label))
    return learn.with_tokens(frame(spark, rows)).cache()


def test_residual_is_the_gradient(spark, training):
    """Against the loss itself, moved a little in each direction."""
    settings = learn.Settings(rounds=3, features=64)
    model = learn.fit(training, 42, settings)
    left = learn.fit_residual(model, training, 42, settings).collect()
    found = {r["feature"]: r["residual"] for r in left}
    last = model.stages[-1]
    data = model.transform(learn.training_rows(training, 42, settings)).collect()
    x = np.array([r[last.getFeaturesCol()].toArray() for r in data])
    y, w = (np.array([r[c] for r in data], float) for c in ("label", "weight"))
    mean = (w[:, None] * x).sum(0) / w.sum()
    spread = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))

    def loss(beta, level):
        z = x @ beta + level
        fit = (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum()
        return fit + settings.decay / 2 * ((beta * spread) ** 2).sum()

    beta, level, step = last.coefficients.toArray(), last.intercept, 1e-5
    assert len(found) > 20 and max(map(abs, found.values())) > 1e-4
    for j, residual in found.items():
        move = np.zeros(len(beta))
        if j >= 0:
            move[j] = step / spread[j]
        up, down = (loss(beta + s * move, level + s * step * (j < 0)) for s in (1, -1))
        assert abs((up - down) / (2 * step) - residual) < 1e-6


def test_a_finished_fit_has_none_left(spark, training):
    settings = learn.Settings(rounds=300, features=64)
    left = learn.fit_residual(learn.fit(training, 42, settings), training, 42, settings)
    assert left.filter("abs(residual) > 1e-6").count() == 0


def test_new_areas(spark):
    rng = random.Random(3)
    words = [a + b for a in "abcdefgh" for b in "ijklmnop"]
    rows = [(" ".join(rng.choices(words, k=12)), bool(i % 2)) for i in range(400)]
    rows += [("fresh topic " + words[i % 9], True) for i in range(40)]
    rows += [("stale topic " + words[i % 9], False) for i in range(40)] + [("fresh", None)]
    df = spark.createDataFrame(rows, "text string, is_new boolean")
    found = {r["word"]: r for r in new_areas(df).collect()}
    assert {w for w, r in found.items() if r["new_area"]} == {"fresh"}
    assert found["stale"]["ratio"] > 20 and (found["fresh"]["n_new"], found["fresh"]["n_old"]) == (40, 0)
    c = d = 240
    gain = 40 * math.log(2) + 200 * math.log(200 / 220) + 240 * math.log(240 / 220)
    assert abs(found["fresh"]["ratio"] - 2 * gain) < 1e-5 and c == d
    one = new_areas(df.filter("is_new")).collect()
    assert one and not any(r["new_area"] or r["ratio"] for r in one)
    assert new_areas(df.limit(0)).count() == 0


def test_tail(spark):
    xs = [0.0, 0.1, 1.0, 3.841, 6.635, 10.83, 20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    for x, p in df.select("x", chi_squared_tail(F.col("x"))).collect():
        assert abs(p - math.erfc(math.sqrt(x / 2))) < 2e-7
