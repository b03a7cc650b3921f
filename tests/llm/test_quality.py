from __future__ import annotations

import os
import random

import numpy as np
import pytest

from utterance_guard.llm.common import table
from utterance_guard.llm.quality import (
    ABUSE, BAD, GOOD, MEASURES, LatentClass, Seen, abuse_votes, classify, form_votes, keep_good,
    measures, pattern, train, votes_in,
)

DOCS = "doc_id long, text string, kept int, score string, _judged int"
LABELS = "doc_id long, quality int, toxic int, text string"
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def form(text):
    data = text.encode()
    words = data.split()
    votes = form_votes(measures(words, data), len(words))
    return {name: v for (name, *_), v in zip(MEASURES, votes) if v == BAD}


def test_labellers():
    prose = "It was a fine day in the old town, and many people came. They sat down. So it was."
    assert not form(prose) and not form("ÄÖ ü. " * 5 + prose)
    assert {"upper", "loud"} <= form("!! ".join(prose.upper().split()) + "!!").keys()
    assert {"marked", "symbols"} <= form(" ".join(w + "###" for w in prose.split())).keys()
    assert {"distinct", "most"} <= form("spam " * 200).keys()
    assert "bare" in form(" | ".join(prose.split()))
    assert not form("Few words.")
    assert abuse_votes({b"a", b"x"}, {b"x": 2, b"y": 0}) == [GOOD, 0, BAD]
    assert abuse_votes({b"a"}, {}) == [0] * ABUSE


def test_patterns():
    votes = [0, 2, 1, 1, 0, 2]
    assert votes_in(pattern(votes), 6) == votes


def test_em_finds_classes_and_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    right, answers = [0.95, 0.9, 0.85, 0.6], [0.9, 0.7, 1, 0.5]
    votes = np.stack(
        [
            np.where(rng.random(truth.size) < a, np.where(truth == (rng.random(truth.size) < r), BAD, GOOD), 0)
            for r, a in zip(right, answers)
        ], axis=1,
    )
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = LatentClass(4).fit(rows.tolist(), counts.tolist())
    assert model.accuracy() == pytest.approx(right, abs=0.03)
    assert model.prior[1] == pytest.approx(0.2, abs=0.02)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95
    assert LatentClass(4).fit([], []).posterior(np.zeros((1, 4), int)) == pytest.approx(0.1)


def test_scorer_learns_soft_labels():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(10, 5000, 30)) for _ in range(600)]
    bad = rng.random(600) < 0.3
    rows = [np.append(r, 3) if b else r for r, b in zip(rows, bad)]
    scorer = train(rows, np.where(bad, 0.97, 0.02))
    assert all((scorer.bad(r) > 0.5) == b for r, b in zip(rows, bad))
    assert (scorer.weights != 0).sum() < 2500
    assert train([], np.zeros(0)).bad(np.array([1])) < 0.5


def corpus():
    rng = random.Random(2)
    word = [f"{a}{b}" for a in "the of was tion ing er".split() for b in "a st on in ou re".split()]
    rows, labels = [], []
    for i in range(400):
        text = ". ".join(" ".join(rng.choices(word, k=9)) for _ in range(6)) + "."
        kind = ("good", "good", "good", "shout", "marks", "abuse")[i % 6]
        if kind == "shout":
            text = "!! ".join(text.upper().split()) + "!!"
        if kind == "marks":
            text = " ".join(w + rng.choice(("###", "%%%")) for w in text.split())
        if kind == "abuse":
            text += " " + " ".join(rng.sample(("zork", "blorf", "gnah", "fitz"), 3))
        rows.append((i, text, 0, "s", 0))
        if i % 2:
            labels.append((i, int(kind in ("good", "abuse")), int(kind == "abuse"), "t"))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    extra = [(1000, None, 1, "", 1), (1001, "", 1, "", 1), (None, rows[0][1], 0, "", 0), rows[1]]
    docs = spark.createDataFrame(rows + extra, DOCS).repartition(3)
    known = spark.createDataFrame(labels + [(None, 1, 0, ""), (5, None, None, "")], LABELS)
    found = classify(docs, known)
    kept = [(r["doc_id"], r["kept"]) for r in found.collect()]
    assert len(kept) == len(rows) + 4
    for doc_id, k in kept:
        assert k == (doc_id is None or doc_id < 1000 and doc_id % 6 < 3), doc_id
    left = keep_good(docs, known)
    assert left.columns == docs.columns and left.count() == sum(k for _, k in kept)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert classify(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "one text only", 0, "", 0)], DOCS)
    assert classify(docs, labels).first()["kept"] is True


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_labels(spark):
    """Labels are not used to train, but for the word list."""
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    rows = classify(docs, labels).join(labels, "doc_id").collect()
    low = [r["kept"] for r in rows if r["quality"] == 0]
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean(low) < 0.1 and np.mean(clean) > 0.98


def test_long_text():
    assert Seen.of(b"word " * 200_000, {}) is not None and Seen.of(b" \n", {}) is None
