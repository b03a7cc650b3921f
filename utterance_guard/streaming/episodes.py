"""Episodes as they happen: a signal when one opens, another when it has closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from utterance_guard.streaming.alerts import EPISODE_GAP_SECONDS, episodes_batch

OPEN, CLOSED = "open", "closed"
SPAN = "first_us bigint, last_us bigint, n bigint"
SIGNAL = "speaker bigint, signal string, " + SPAN
#: The state provider that the operator needs; set it on the session before the stream starts.
PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def joined(spans: list[tuple[int, int, int]], us: int, gap: int) -> tuple[list, bool]:
    """Spans with an alert added, and whether it began one. An alert between two spans that are
    near enough makes them one."""
    near = [s for s in spans if s[0] - gap <= us <= s[1] + gap]
    if not near:
        return sorted([*spans, (us, us, 1)]), True
    first = min(us, *(s[0] for s in near))
    last = max(us, *(s[1] for s in near))
    rest = [s for s in spans if s not in near]
    return sorted([*rest, (first, last, 1 + sum(s[2] for s in near))]), False


class Episodes(StatefulProcessor):
    """The spans of a speaker that may still grow; a timer stands at the end of each."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", SPAN)

    def _held(self) -> list[tuple[int, int, int]]:
        return [tuple(map(int, s)) for s in self.spans.get()] if self.spans.exists() else []

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        if not spans:
            self.spans.clear()
            return
        self.spans.put(spans)
        for _, last, _ in spans:
            self.handle.registerTimer((last + self.gap) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        spans, opened = self._held(), []
        for us in sorted(u for part in rows for u in part["us"].tolist()):
            spans, new = joined(spans, int(us), self.gap)
            if new:
                opened.append((key[0], OPEN, int(us), None, None))
        self._keep(spans)
        yield table(opened)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a span whose end has moved on since has a later timer too
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self._held()
        over = [s for s in spans if s[1] + self.gap < passed]
        if over:
            self._keep([s for s in spans if s not in over])
        yield table([(key[0], CLOSED, *s) for s in over])

    def close(self) -> None:
        pass


def table(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SIGNAL.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"speaker": "int64", "first_us": "int64", "last_us": "Int64", "n": "Int64"})


def episode_signals(
    alerted: DataFrame,
    gap_seconds: float = EPISODE_GAP_SECONDS,
    late: str = "1 minute",
    speaker: str = "speaker_id",
    ts: str = "ts",
) -> DataFrame:
    """``speaker_id, signal, first_ts, last_ts, n_alerts`` of a stream of alerts.

    ``open`` comes with the micro-batch of an episode's first alert, ``closed`` once the
    watermark has passed the gap after its last. Alerts that come out of order, but not later
    than ``late``, extend an episode or join two, so what is closed is what a batch job finds;
    the second of two that were joined has an ``open`` of its own. Older rows are dropped. State
    is a row for each episode that is not over. The session needs ``PROVIDER``.
    """
    gap = round(gap_seconds * 1_000_000)
    timed = alerted.withWatermark(ts, late).select(
        F.col(speaker).cast("long").alias("speaker"), F.col(ts), F.unix_micros(ts).alias("us")
    )
    signals = timed.groupBy("speaker").transformWithStateInPandas(
        statefulProcessor=Episodes(gap),
        outputStructType=SIGNAL,
        outputMode="Append",
        timeMode="EventTime",
    )
    return _named(signals, speaker)


def _named(signals: DataFrame, speaker: str) -> DataFrame:
    return signals.select(
        F.col("speaker").alias(speaker),
        "signal",
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"),
        F.col("n").alias("n_alerts"),
    )


def episode_signals_batch(
    alerted: DataFrame,
    gap_seconds: float = EPISODE_GAP_SECONDS,
    speaker: str = "speaker_id",
    ts: str = "ts",
) -> DataFrame:
    """Both signals of every episode, for data at rest."""
    whole = episodes_batch(alerted, gap_seconds, speaker, ts)
    none = (F.lit(None).cast("timestamp"), F.lit(None).cast("long"))
    both = F.array(
        F.struct(F.lit(OPEN).alias("signal"), none[0].alias("last"), none[1].alias("n")),
        F.struct(F.lit(CLOSED).alias("signal"), F.col("last_ts").alias("last"),
                 F.col("n_alerts").alias("n")),
    )
    rows = whole.select(speaker, "first_ts", F.inline(both))
    return rows.select(
        speaker, "signal", "first_ts", F.col("last").alias("last_ts"), F.col("n").alias("n_alerts")
    )
