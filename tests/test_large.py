"""Hot keys, large lexicons, files in many splits, repeated runs, splits by text."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from utterance_guard.functions.text import HARASSMENT_LABEL
from utterance_guard.operators import curate, patterns, scoring
from utterance_guard.operators.cascade import moderate
from utterance_guard.operators.lexicon import blocklist
from utterance_guard.operators.patterns import PatternIndex
from utterance_guard.operators.sizes import uses_that_fit
from utterance_guard.operators.skew import SALT, hot_keys, salted, skewed_join
from utterance_guard.plans import fixed
from utterance_guard.sources import files
from utterance_guard.sources.contract import HISTORY


# hot keys


def rows_with_a_hot_key(spark, n=900):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 200}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, token string")


def test_only_listed_keys_are_copied(spark):
    many = rows_with_a_hot_key(spark)
    few = spark.createDataFrame(
        [("hot", 1), ("k1", 2), ("k1", 3), ("other", 4), (None, 5)], "token string, w int"
    )
    assert hot_keys(many, "token", 8) == ["hot"]
    _, copies = salted(["hot"], "token", 8, "row_id")
    spread = few.withColumn(SALT, F.explode(copies)).groupBy("token").count().collect()
    assert {r["token"]: r["count"] for r in spread} == {"hot": 8, "k1": 2, "other": 1, None: 1}
    found = skewed_join(many, few, "token", "row_id")
    assert found.columns == ["token", "row_id", "w"]
    wanted = many.join(few, "token")
    assert sorted(found.collect()) == sorted(wanted.select(*found.columns).collect())


def test_hot_rows_are_spread(spark):
    many = rows_with_a_hot_key(spark, 3000)
    own, _ = salted(["hot"], "token", 8, "row_id")
    shares = many.withColumn("s", own).filter("token = 'hot'").groupBy("s").count().collect()
    assert len(shares) == 8 and max(r["count"] for r in shares) < 1000 / 4


def test_no_hot_key_and_empty_side(spark):
    even = spark.createDataFrame([(i, f"k{i}") for i in range(100)], "row_id long, token string")
    assert hot_keys(even, "token", 4) == []
    assert hot_keys(even.limit(0), "token", 4) == []
    few = spark.createDataFrame([("k7", 1)], "token string, w int")
    assert skewed_join(even, few, "token", "row_id").count() == 1
    assert skewed_join(even.limit(0), few, "token", "row_id").count() == 0


def test_joined_plans_with_a_token_in_a_third_of_all_rows(spark):
    texts = ["worthless trash everywhere" if i % 3 == 0 else f"plain text {i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    lexicon = fixed.substring_lexicon(spark)
    joined = blocklist(df, lexicon, inline_limit=0, index_chars=0, can_broadcast=False)
    inline = blocklist(df, lexicon)
    assert sorted(joined.collect()) == sorted(inline.collect())


# large lexicons


def test_index_finds_overlaps_and_repeats():
    index = PatternIndex(["b", "abc", "bc", "b", "😀", "zz"])
    assert index.find("xabc😀") == [0, 1, 2, 3, 4]
    assert index.find("") == index.find(None) == [] == PatternIndex([]).find("abc")


def big_lexicon(spark, n=400):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(n)]
    return files.make_lexicon(spark, words, "list_a").unionByName(
        files.make_lexicon(spark, ["a b", "cd é", "b"], "list_b", files.PHRASE)
    )


@pytest.mark.parametrize("can_broadcast", [True, False])
def test_index_equals_join(spark, can_broadcast):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé  ", k=40)) for _ in range(60)] + [None, "", "A B", "Cd,É"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    lexicon = big_lexicon(spark)
    indexed = blocklist(df, lexicon)
    joined = blocklist(df, lexicon, index_chars=0, can_broadcast=can_broadcast)
    assert sorted(indexed.collect(), key=str) == sorted(joined.collect(), key=str)
    plan = indexed._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan and "Exchange" not in plan


def test_a_filter_does_not_search_twice(spark):
    df = spark.createDataFrame([(1, "abc")], "row_id long, text string")
    plan = blocklist(df, big_lexicon(spark)).filter("matched")._jdf.queryExecution()
    assert plan.executedPlan().toString().count("ArrowEvalPython") == 1


def test_large_lexicon_on_a_stream(spark, tmp_path):
    folder, lexicon = str(tmp_path / "in"), big_lexicon(spark)
    df = spark.createDataFrame([(1, "abc cd é"), (2, "xyz")], "row_id long, text string")
    df.write.parquet(folder)
    live = spark.readStream.schema(df.schema).parquet(folder)
    out = moderate(live, lexicon, fixed.scorer(spark))
    query = out.writeStream.format("memory").queryName("large").trigger(availableNow=True).start()
    query.awaitTermination(120)
    wanted = moderate(df, lexicon, fixed.scorer(spark))
    assert sorted(spark.table("large").collect()) == sorted(wanted.collect())
    assert spark.table("large").filter(F.col("label") == HARASSMENT_LABEL).count() == 1


def test_size_is_measured_first(spark):
    lexicon = big_lexicon(spark, 50)
    assert patterns.entries_if_small(lexicon, chars=10) is None
    assert patterns.entries_if_small(lexicon, entries=10) is None
    assert len(patterns.entries_if_small(lexicon)) == lexicon.count()
    assert patterns.entries_if_small(lexicon.limit(0)) == []


# files


@pytest.mark.parametrize("split", ["64", "1000", "134217728"])
def test_line_numbers_over_many_splits(spark, tmp_path, split):
    rng, lines = random.Random(1), []
    for name in ("b", "a", "c", "d"):
        own = [f"{name}{i} " + "é" * rng.randrange(30) if rng.random() < 0.9 else " "
               for i in range(rng.choice((0, 1, 40, 90)) or 25)]
        (tmp_path / f"{name}.txt").write_text("\n".join(own) + ("\n" if name < "c" else ""))
        lines.append((name, own))
    (tmp_path / "empty.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = files.read_utterances(spark, str(tmp_path)).orderBy("row_id").collect()
        whole = [r["row_id"] for r in files.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    in_order = [line for _, own in sorted(lines) for line in own]
    assert sorted(whole) == list(range(len(in_order)))
    assert [(r["row_id"], r["text"]) for r in found] == [
        (i, line.strip()) for i, line in enumerate(in_order) if line.strip()
    ]


def test_output_in_input_order(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("\n".join(f"line {i}" for i in range(500)))
    rows = files.read_utterances(spark, str(source)).repartition(7)
    files.write_csv(rows, str(tmp_path / "out"), ["text"], order_by="row_id")
    again = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert [r["text"] for r in again.collect()] == [f"line {i}" for i in range(500)]


def test_a_repeated_run_is_one_row(spark, tmp_path):
    path = str(tmp_path / "history")

    def row(value):
        return spark.createDataFrame([(dt.datetime(2024, 1, 1), 5, 66, value, 0.5, 0.5, 0.5)], HISTORY)

    for value in (0.25, 0.75, 0.75):
        assert files.append_history(row(value), path, run_id="nightly/2024-01-01")
    files.append_history(row(0.5), path, run_id="other")
    files.append_history(row(0.1), path)
    # what a killed attempt leaves behind
    (tmp_path / "history" / "run=killed" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "history" / "run=killed" / "_temporary" / "0" / "part-0.parquet").write_text("x")
    rows = files.read_history(spark, path)
    assert rows.columns == HISTORY.names
    assert sorted(r["accuracy"] for r in rows.collect()) == [0.1, 0.5, 0.75]


# splits


def check_split(spark, rows, percent):
    df = spark.createDataFrame(rows, "row_id long, text string, label int, more int")
    out = curate.split_texts(df, 42, percent)
    assert out.columns == [*df.columns, "side"]
    got = out.collect()
    assert Counter((r["row_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    sides = {}
    for r in got:
        sides.setdefault(r["text"], set()).add(r["side"])
    assert all(len(s) == 1 for s in sides.values())
    strata = {}
    for t in sides:
        labels = [r[2] for r in rows if r[1] == t and r[2] is not None]
        size = sum(r[1] == t for r in rows)
        strata.setdefault(min(labels) if labels else None, []).append((t, size))
    for groups in strata.values():
        total = sum(n for _, n in groups)
        held = sum(n for t, n in groups if sides[t] == {"eval"})
        # moving the border by a group does not bring it nearer
        assert abs(held - total * percent / 100) <= max(n for _, n in groups) / 2
    return got


@pytest.mark.parametrize("percent", [0, 15, 50, 100])
def test_split_by_text(spark, percent):
    rng = random.Random(percent)
    rows = [(i, f"t{rng.randrange(60)}", rng.randrange(2), 0) for i in range(300)]
    rows += [(300 + i, "hot text", i % 2, 0) for i in range(150)]
    rows += [(500, None, 1, 0), (501, None, 0, 0), (502, "", None, 0), (503, "lone", None, 0)]
    got = check_split(spark, rows, percent)
    assert {r["side"] for r in got} == (
        {"train"} if percent == 0 else {"eval"} if percent == 100 else {"train", "eval"}
    )


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, text string, label int")
    assert curate.split_texts(df, 1).count() == 0


@pytest.mark.parametrize("least", [1, 3, 1 << 62])
@pytest.mark.parametrize("kind", ["decimal(18,4)", "decimal(18,12)", "double"])
def test_only_uncommon_tokens_of_a_large_vocabulary_are_shuffled(spark, monkeypatch, least, kind):
    texts = [(1, "the the rare"), (2, "the odd odd odd"), (3, ""), (4, "unknown"), (None, "the")]
    df = spark.createDataFrame(texts, "row_id bigint, text string")
    rows = [(m, t, str(w * m)) for m in (1, 2) for t, w in (("the", 0.25), ("rare", 2), ("odd", -1))]
    weights = spark.createDataFrame(rows, "member int, token string, w string").withColumn(
        "w", F.col("w").cast(kind)
    )
    monkeypatch.setattr(scoring, "uses_that_fit", lambda used, uses: least)
    model = scoring.WeightScorer(
        weights, {1: Decimal("0.5"), 2: Decimal("-0.5")}, inline_tokens=0, can_broadcast=False
    )
    got = {r["row_id"]: [float(m) for m in r["margins"]] for r in model.margins(df).collect()}
    assert got == {
        1: [3.0, 4.5], 2: [-2.25, -6.0], 3: [0.5, -0.5], 4: [0.5, -0.5], None: [0.5, -0.5]
    }
    if kind == "decimal(18,4)":  # a sum of decimals makes an object per token
        assert {t for c, t in model._wide().dtypes if c != "token"} == {"bigint"}


def test_the_most_used_rows_fit(spark):
    rows = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 1)], "t string, uses bigint")
    assert [uses_that_fit(rows, "uses", max_rows=n) for n in (4, 3, 2, 1)] == [1, 4, 8, 2**62]
    assert uses_that_fit(rows, "uses", max_bytes=3 * 17) == 4
    assert uses_that_fit(rows.limit(0), "uses") == 2**62
