"""Alerts on speech: per utterance, per episode, per day. Functions take a batch or a stream
unless their name says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from utterance_guard.functions.text import KEYWORDS, keyword_hit
from utterance_guard.operators.cascade import moderate
from utterance_guard.operators.metrics import verdict_summary
from utterance_guard.operators.scoring import isolated

# Fixed value: how long an alert stays on screen, in seconds.
EPISODE_GAP_SECONDS = 6.0


def final_utterances(df: DataFrame) -> DataFrame:
    """Interim transcripts are for display only."""
    return df.filter("is_final")


def with_alert(df: DataFrame) -> DataFrame:
    """Keyword hit or verdict. The two checks are independent: where one has no answer (null),
    the other stays in force."""
    no = F.lit(False)
    return df.withColumn("alert", F.coalesce("keyword", no) | F.coalesce("is_nondeli", no))


def alerts(
    utterances: DataFrame,
    lexicon: DataFrame,
    scorer,
    words: list[str] | tuple[str, ...] = KEYWORDS,
    row_id: str = "row_id",
) -> DataFrame:
    """Online verdict and keyword check of every final utterance. Stateless.

    The keyword check reads the transcript as it came, the cascade a stripped copy. An outside
    model that raises costs the texts it raised for their verdict and nothing else: their
    keyword check stands, and ``error`` says what happened.
    """
    final = final_utterances(utterances).withColumn("keyword", keyword_hit("text", words))
    return with_alert(moderate(final, lexicon, isolated(scorer), "online", row_id))


def new_results(
    utterances: DataFrame,
    late: str = "1 minute",
    speaker: str = "speaker_id",
    number: str = "result_no",
    ts: str = "ts",
) -> DataFrame:
    """Final utterances of a stream, each once: a recogniser sends its list of results again
    and again, and a final one does not change any more. State is one row per result until the
    watermark has passed it by ``late``. An utterance without a number is always new."""
    final = final_utterances(utterances).withWatermark(ts, late)
    numbered = final.filter(F.col(number).isNotNull())
    return numbered.dropDuplicatesWithinWatermark([speaker, number]).unionByName(
        final.filter(F.col(number).isNull())
    )


def latest_results(
    utterances: DataFrame,
    speaker: str = "speaker_id",
    number: str = "result_no",
    ts: str = "ts",
) -> DataFrame:
    """The last transcript of each numbered result, for data at rest: a final one comes after
    interim ones of the same time, then the greater text. Rows without a number all stay."""
    rest = [c for c in utterances.columns if c not in (speaker, number)]
    numbered = utterances.filter(F.col(number).isNotNull())
    last = numbered.groupBy(speaker, number).agg(
        F.max_by(F.struct(*rest), F.struct(ts, "is_final", "text")).alias("_last")
    )
    kept = last.select(*[F.col(c) if c in (speaker, number) else F.col("_last")[c].alias(c)
                         for c in utterances.columns])
    return kept.unionByName(utterances.filter(F.col(number).isNull()))


def episodes_stream(
    alerted: DataFrame,
    gap_seconds: float = EPISODE_GAP_SECONDS,
    late: str = "1 minute",
    speaker: str = "speaker_id",
    ts: str = "ts",
) -> DataFrame:
    """Alerts of a speaker no further apart than the gap are one episode.

    An episode is final once the watermark has passed its end; rows later than ``late`` are
    dropped. State is one row per open episode.
    """
    micros = round(gap_seconds * 1_000_000)
    return (
        alerted.withWatermark(ts, late)
        .groupBy(speaker, F.session_window(ts, f"{micros} microseconds").alias("session"))
        .agg(F.count("*").alias("n_alerts"), F.max(ts).alias("last_ts"))
        .select(speaker, F.col("session.start").alias("first_ts"), "last_ts", "n_alerts")
    )


def episodes_batch(
    alerted: DataFrame,
    gap_seconds: float = EPISODE_GAP_SECONDS,
    speaker: str = "speaker_id",
    ts: str = "ts",
) -> DataFrame:
    """The same episodes for data at rest.

    Time is cut into slices as long as the gap. Alerts inside a slice always belong together,
    so each speaker's slice is one row after a partial aggregation; the window then runs over
    slices, of which even a speaker with a third of all alerts has no more than the calendar
    allows.
    """
    gap = round(gap_seconds * 1_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slices = (
        alerted.select(speaker, micros.alias("us"))
        .groupBy(speaker, (F.col("us") - F.pmod("us", F.lit(gap))).alias("slice"))
        .agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))
    )
    by_speaker = W.partitionBy(speaker).orderBy("first")
    before = F.lag("last").over(by_speaker)
    numbered = slices.withColumn(
        "starts", (before.isNull() | (F.col("first") > before + gap)).cast("int")
    ).withColumn("episode", F.sum("starts").over(by_speaker))
    return (
        numbered.groupBy(speaker, "episode")
        .agg(F.min("first").alias("f"), F.max("last").alias("l"), F.sum("n").alias("n_alerts"))
        .select(
            speaker,
            F.timestamp_micros("f").alias("first_ts"),
            F.timestamp_micros("l").alias("last_ts"),
            "n_alerts",
        )
    )


def windowed_verdicts(
    verdicts: DataFrame, width: str = "1 day", ts: str = "ts", late: str | None = None
) -> DataFrame:
    """Verdict counts per time window. Give ``late`` for a stream: it bounds the state, and
    rows later than that are dropped."""
    if late:
        verdicts = verdicts.withWatermark(ts, late)
    counted = verdict_summary(verdicts, F.window(ts, width).alias("window"))
    return counted.select(
        F.col("window.start").alias("start"), "n", "n_harassment", "n_review"
    )


def alert_stream(
    utterances: DataFrame,
    lexicon: DataFrame,
    scorer,
    path: str,
    checkpoint: str,
    words: list[str] | tuple[str, ...] = KEYWORDS,
    row_id: str = "row_id",
    available_now: bool = False,
) -> StreamingQuery:
    """Alerts of a stream, written to Parquet, with a lexicon and a vocabulary of any size: each
    micro-batch goes through the batch operator. A batch has a folder of its own, named by its
    id and overwritten when the batch is repeated, so the output holds every row once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = alerts(batch, lexicon, scorer, words, row_id)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = utterances.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_stream(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False
) -> StreamingQuery:
    """Write to Parquet, exactly once. Both folders must be shared by all executors."""
    writer = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
