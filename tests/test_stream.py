from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from utterance_guard.plans import fixed
from utterance_guard.sources.contract import SPEECH
from utterance_guard.sources.files import speech_messages, speech_stream
from utterance_guard.streaming import alerts as speech

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = [
    (1, 0.0, "you idiot", True), (1, 6.0, "such a moron, a pathetic loser", True),
    (1, 12.1, "fine", True), (1, 13.0, "idiot again", True), (1, 14.0, "idiot", False),
    (2, 3.0, "hello there", True), (2, 4.0, "Idiot", True), (1, 500.0, "idiot late", True),
    (2, 900.0, "idiot end", True),
]


def rows(spark):
    data = [(s, START + dt.timedelta(seconds=t), text, final) for s, t, text, final in ROWS]
    return spark.createDataFrame(data, SPEECH)


def with_id(df):
    return df.withColumn("row_id", F.concat_ws("-", "speaker_id", F.unix_micros("ts")))


def alerted(df, spark):
    return speech.alerts(
        with_id(df), fixed.two_lexicons(spark), fixed.scorer(spark), fixed.KEYWORDS
    )


def run(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    query = speech.write_stream(df, out, str(tmp_path / f"{name}_state"), available_now=True)
    query.awaitTermination(120)
    return spark.read.parquet(out)


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark).write.parquet(folder)
    streamed = run(spark, alerted(speech_stream(spark, folder), spark), tmp_path, "alerts")
    batch = alerted(rows(spark), spark)
    columns = ["row_id", "keyword", "is_nondeli", "reason", "alert"]
    assert sorted(streamed.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert batch.filter("alert").count() == 6 and batch.count() == 8

    episodes = speech.episodes_stream(
        alerted(speech_stream(spark, folder), spark).filter("alert"), 6.0, late="1 second"
    )
    closed = {tuple(r) for r in run(spark, episodes, tmp_path, "episodes").collect()}
    everything = {tuple(r) for r in speech.episodes_batch(batch.filter("alert"), 6.0).collect()}
    assert closed < everything
    assert len(everything) == 5
    assert (1, START.replace(tzinfo=None), dt.datetime(2024, 1, 1, 0, 0, 6), 2) in {
        (s, a.replace(tzinfo=None), b.replace(tzinfo=None), n) for s, a, b, n in everything
    }


def test_episode_gap_is_inclusive(spark):
    def episodes(*seconds):
        data = [(1, START + dt.timedelta(seconds=s)) for s in seconds]
        df = spark.createDataFrame(data, "speaker_id bigint, ts timestamp")
        return speech.episodes_batch(df, 6.0).count()

    assert episodes(0, 6) == 1
    assert episodes(0, 6.000001) == 2
    assert episodes(5.9, 6.1, 12.1, 18.2) == 2


def test_keyword_stands_in_for_a_missing_verdict(spark):
    df = spark.sql("SELECT true AS keyword, cast(null AS boolean) AS is_nondeli")
    assert speech.with_alert(df).first()["alert"] is True


def test_windowed_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark).write.parquet(folder)
    verdicts = speech_stream(spark, folder).select(
        "ts", F.lit("x").alias("label"), F.lit(True).alias("needs_review")
    )
    counted = run(
        spark, speech.windowed_verdicts(verdicts, "1 minute", late="1 second"), tmp_path, "daily"
    )
    assert {(r["n"], r["n_review"]) for r in counted.collect()} == {(7, 7), (1, 1)}


def test_messages(spark):
    df = spark.sql("""SELECT cast('{"speaker_id": 1, "text": "a", "is_final": true}' AS binary) value""")
    assert speech_messages(df).first()["text"] == "a"
