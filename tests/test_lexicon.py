"""All ways to match a lexicon give one answer."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from utterance_guard.operators.lexicon import blocklist
from utterance_guard.sources.files import PHRASE, SUBSTRING

LETTERS = st.text("ab😀é ", min_size=0, max_size=12)
WORDS = st.text("ab😀é", min_size=1, max_size=6)
ENTRY = st.tuples(
    st.sampled_from(["x", "y"]), st.integers(0, 3), WORDS, st.sampled_from([SUBSTRING, PHRASE])
)


def answers(spark, texts, entries, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    lexicon = spark.createDataFrame(
        entries, "source string, ord bigint, word string, mode string"
    )
    found = blocklist(df, lexicon, **how)
    return sorted(
        (r["row_id"], r["matched_words"], r["matched_sources"]) for r in found.collect()
    )


def same(spark, texts, entries):
    inline = answers(spark, texts, entries, inline_limit=1000)
    assert inline == answers(spark, texts, entries, inline_limit=0, can_broadcast=True)
    assert inline == answers(spark, texts, entries, inline_limit=0, can_broadcast=False)
    return inline


@settings(
    max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(st.one_of(st.none(), LETTERS), min_size=1, max_size=8),
    st.lists(ENTRY, min_size=1, max_size=8),
)
def test_three_ways(spark, texts, entries):
    same(spark, texts, entries)


def test_repeats_emoji_and_short_words(spark):
    texts = ["a😀bc", "abcdef", None, "", "it is a b", "😀"]
    entries = [
        ("x", 0, "😀b", SUBSTRING), ("x", 0, "😀b", SUBSTRING), ("x", 1, "a", SUBSTRING),
        ("x", 2, "bcde", SUBSTRING), ("y", 3, "abcdef", SUBSTRING), ("y", 4, "a b", PHRASE),
        ("y", 5, "😀", SUBSTRING),
    ]
    found = dict((r[0], r[1]) for r in same(spark, texts, entries))
    assert found[0] == ["😀b", "😀b", "a", "😀"]
    assert found[1] == ["a", "bcde", "abcdef"]
    assert found[2] == [] and found[4] == ["a", "[phrase]"]


@pytest.mark.parametrize("limit", [0, 1000])
def test_without_phrases(spark, limit):
    assert answers(spark, ["abc"], [("x", 0, "zz", SUBSTRING)], inline_limit=limit) == [(0, [], [])]
