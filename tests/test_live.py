"""What a user of the live screen meets: failing models, results sent again, open episodes."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterance_guard.operators.cascade import moderate
from utterance_guard.operators.scoring import OutsideScorer, isolated
from utterance_guard.plans import fixed
from utterance_guard.sources.contract import SPEECH, SPEECH_RESULTS
from utterance_guard.sources.files import speech_stream
from utterance_guard.streaming import alerts as speech
from utterance_guard.streaming import episodes

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def drain(spark, df, out, state):
    speech.write_stream(df, str(out), str(state), available_now=True).awaitTermination(180)
    return spark.read.schema(df.schema).parquet(str(out))


def picky(raises):
    def load():
        def logits(texts):
            if any(raises(t) for t in texts):
                raise RuntimeError("backend down")
            return np.array([[0.0, 1.0 if "bad" in t else -1.0] for t in texts])

        return logits

    return OutsideScorer({1: load, 2: load})


def broken():
    def load():
        raise OSError("no model")

    return OutsideScorer({1: load})


TEXTS = ["bad thing", "fine", "poison one", "you idiot poison", "trash poison", None, "", "bad"]


def speech_rows(spark, texts=TEXTS):
    rows = [(i % 3, at(i), t, True) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SPEECH).repartition(1)
    return df.withColumn("row_id", F.unix_seconds("ts") - int(START.timestamp()))


def test_a_failing_text_costs_only_its_own_verdict(spark):
    out = speech.alerts(
        speech_rows(spark), fixed.two_lexicons(spark), picky(lambda t: "poison" in t),
        ("idiot",),
    )
    rows = {r["row_id"]: r for r in out.collect()}
    assert len(rows) == len(TEXTS)
    assert [rows[i]["is_nondeli"] for i in range(8)] == [
        True, False, None, True, True, False, False, True,
    ]
    assert rows[2]["error"] == "RuntimeError: backend down" and rows[2]["reason"] == "scorer_error"
    assert rows[2]["label"] is None and rows[2]["confidence"] is None
    assert [i for i, r in rows.items() if r["error"]] == [2]  # the lexicon settles 3 and 4
    assert rows[3]["keyword"] and rows[3]["alert"] and not rows[2]["alert"]


def test_a_keyword_is_heard_while_the_model_is_away(spark):
    texts = ["moron here", "quiet", "Idiot"]
    out = speech.alerts(speech_rows(spark, texts), fixed.two_lexicons(spark), broken(),
                        ("moron", "Idiot"))
    rows = {r["row_id"]: r for r in out.collect()}
    assert [rows[i]["alert"] for i in range(3)] == [True, False, True]
    assert rows[1]["error"] == "OSError: no model" and rows[0]["is_nondeli"] is None


def test_failures_end_a_batch_job_unless_asked(spark):
    df = spark.createDataFrame([(1, "poison")], "row_id long, text string")
    scorer = picky(lambda t: True)
    with pytest.raises(Exception, match="backend down"):
        moderate(df, fixed.two_lexicons(spark), scorer).collect()
    row = moderate(df, fixed.two_lexicons(spark), isolated(scorer)).first()
    assert row["label"] is None and "backend down" in row["error"]
    with pytest.raises(ValueError, match="error"):
        moderate(df.withColumn("error", F.lit(1)), fixed.two_lexicons(spark), isolated(scorer))


def test_stream_goes_on_while_the_model_fails(spark, tmp_path):
    folder = str(tmp_path / "in")
    speech_rows(spark).drop("row_id").write.parquet(folder)
    live = speech_stream(spark, folder).withColumn("row_id", F.unix_seconds("ts"))
    out = drain(
        spark,
        speech.alerts(live, fixed.two_lexicons(spark), picky(lambda t: "poison" in t), ("idiot",)),
        tmp_path / "out", tmp_path / "state",
    )
    assert out.count() == len(TEXTS) and out.filter("error IS NOT NULL").count() == 1
    assert out.filter("keyword").count() == 1


def test_results_sent_again_are_heard_once(spark, tmp_path):
    results = [
        (s, n, at(10 * n + s), f"idiot {n}" if n % 2 else f"word {n}") for s in (1, 2) for n in range(6)
    ]
    rows = [(s, t, text, True, n) for s, n, t, text in results]
    rows += [(s, t - dt.timedelta(milliseconds=200), text[:3], False, n) for s, n, t, text in results]
    rows += [(9, at(1), "idiot unnumbered", True, None)] * 2
    sent = spark.createDataFrame(rows, SPEECH_RESULTS)
    folder = str(tmp_path / "in")
    for _ in range(3):
        sent.coalesce(1).write.mode("append").parquet(folder)
    live = speech_stream(spark, folder, schema=SPEECH_RESULTS, maxFilesPerTrigger="1")
    heard = speech.new_results(live).withColumn("row_id", F.hash("speaker_id", "ts"))
    out = drain(
        spark,
        speech.alerts(heard, fixed.two_lexicons(spark), fixed.scorer(spark), ("idiot",)),
        tmp_path / "out", tmp_path / "state",
    )
    numbered = out.filter("result_no IS NOT NULL")
    assert numbered.count() == len(results)
    assert numbered.filter("alert").count() == 6
    assert out.filter("result_no IS NULL").count() == 6
    at_rest = speech.latest_results(sent.union(sent))
    assert at_rest.columns == sent.columns
    assert sorted(at_rest.filter("result_no IS NOT NULL").collect()) == sorted(
        sent.filter("is_final AND result_no IS NOT NULL").collect()
    )
    assert at_rest.filter("result_no IS NULL").count() == 4


def test_latest_result_breaks_ties(spark):
    rows = [(1, at(5), "abc", False, 1), (1, at(5), "ab", True, 1), (1, at(2), "zz", True, 1),
            (1, at(5), "aa", True, 1)]
    (row,) = speech.latest_results(spark.createDataFrame(rows, SPEECH_RESULTS)).collect()
    assert row["text"] == "ab"


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in episodes.PROVIDER}
    for k, v in episodes.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def signals(df):
    return {
        (r["speaker_id"], r["signal"], r["first_ts"], r["last_ts"], r["n_alerts"])
        for r in df.collect()
    }


def test_open_at_once_closed_after_the_gap(rocks, tmp_path):
    spark, folder = rocks, str(tmp_path / "in")
    rng = random.Random(4)
    times = [(s, round(t + rng.random() * 3, 3)) for s in (1, 2, 3) for t in range(0, 400, 7)
             if rng.random() < 0.6]
    parts = [[], [], []]
    for s, t in times:  # a few alerts come a file late, within what the watermark allows
        parts[min(2, int(t // 134) + (rng.random() < 0.1))].append((s, at(t)))
    schema = "speaker_id bigint, ts timestamp"

    def deliver(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        live = spark.readStream.schema(schema).parquet(folder)
        return drain(spark, episodes.episode_signals(live, 6.0, late="300 seconds"),
                     tmp_path / "out", tmp_path / "state")

    deliver(parts[0])
    after_one = signals(run())
    assert after_one and {x[1] for x in after_one} == {"open"}
    deliver(parts[1])
    run()  # goes on from the checkpoint
    deliver(parts[2])
    deliver([(9, at(2000))])
    found = run()
    whole = spark.createDataFrame([x for p in parts for x in p] + [(9, at(2000))], schema)
    wanted = signals(episodes.episode_signals_batch(whole, 6.0))
    closed = {x for x in wanted if x[1] == "closed" and x[0] != 9}
    assert {x for x in signals(found) if x[1] == "closed"} == closed and len(closed) > 20
    opened = {x for x in signals(found) if x[1] == "open"}
    assert len(opened) >= len(closed)
    assert any(x[0] == 9 for x in opened)
    assert found.groupBy("speaker_id", "signal", "first_ts").count().filter("count > 1").count() == 0


def test_spans_join():
    spans = []
    for us, opened in ((10, True), (30, True), (20, False), (50, True), (40, False)):
        spans, new = episodes.joined(spans, us, 10)
        assert new is opened
    assert spans == [(10, 50, 5)]
    spans, _ = episodes.joined([], 10, 5)
    assert episodes.joined(spans, 16, 5) == ([(10, 10, 1), (16, 16, 1)], True)
