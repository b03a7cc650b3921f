"""The verdict cascade: empty input, then the lexicon, then the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterance_guard.functions.text import (
    HARASSMENT_LABEL,
    NONE_LABEL,
    REVIEW_HIGH,
    REVIEW_LOW,
    blocklist_reason,
    needs_review,
    round4,
    strip,
)
from utterance_guard.operators.lexicon import INLINE_LIMIT, blocklist
from utterance_guard.operators.scoring import individual, with_ensemble

MODEL_SOURCE = "model_ensemble"
EMPTY_REASON = "empty_input"
ERROR_REASON = "scorer_error"
CALLER = "_caller"
VERDICT_COLUMNS = {
    "batch": {"label", "confidence", "needs_review", "source"},
    "online": {"is_nondeli", "label", "confidence", "reason", "individual_seeds"},
}


def _judged(
    df: DataFrame, lexicon: DataFrame, scorer, row_id: str, inline_limit: int
) -> DataFrame:
    """Screen every row, score those that nothing settled, and keep all of them, in one pass
    over the input: where the verdict stands already, the scorer gets a null for the text."""
    screened = blocklist(df, lexicon, "text", row_id, inline_limit=inline_limit)
    open_ = ~(F.col("matched") | F.col("empty"))
    masked = screened.withColumn(
        "model_text", F.when(open_, F.coalesce("normal_text", F.lit("")))
    )
    return with_ensemble(scorer.score(masked, "model_text"))


def moderate(
    df: DataFrame,
    lexicon: DataFrame,
    scorer,
    mode: str = "batch",
    row_id: str = "row_id",
    model_source: str = MODEL_SOURCE,
    low: float = REVIEW_LOW,
    high: float = REVIEW_HIGH,
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """One verdict per row of ``row_id, text``, further columns are passed on.

    ``batch`` gives ``label, confidence, needs_review, source`` with the confidence rounded.
    ``online`` strips the text first, answers empty input, and gives ``is_nondeli, label,
    confidence, reason, individual_seeds`` unrounded. A scorer that isolates failures adds
    ``error``; a row that has one has no label, no confidence and ``scorer_error`` as its reason.
    """
    if mode not in VERDICT_COLUMNS:
        raise ValueError(f"unknown mode: {mode}")
    kept = df.columns
    may_fail = getattr(scorer, "isolate", False)
    taken = VERDICT_COLUMNS[mode] | {CALLER} | ({"error"} if may_fail else set())
    taken = taken.intersection(kept)
    if taken:
        raise ValueError(f"rename before moderating: {', '.join(sorted(taken))}")
    # the caller's columns travel in one, out of the way of those made here
    others = [c for c in kept if c not in (row_id, "text")]
    df = df.select(row_id, "text", *([F.struct(*others).alias(CALLER)] if others else []))
    kept = [F.col(c) if c in (row_id, "text") else F.col(CALLER)[c].alias(c) for c in kept]
    if mode == "online":
        df = df.withColumn("text", strip(F.coalesce("text", F.lit(""))))
        df = df.withColumn("empty", F.col("text") == "")
    else:
        df = df.withColumn("empty", F.lit(False))
    judged = _judged(df, lexicon, scorer, row_id, inline_limit)

    hit, empty = F.col("matched"), F.col("empty")
    label = (
        F.when(empty, NONE_LABEL).when(hit, HARASSMENT_LABEL).otherwise(F.col("label"))
    )
    confidence = F.when(empty | hit, 1.0).otherwise(F.col("confidence"))
    reason = (
        F.when(empty, EMPTY_REASON)
        .when(hit, blocklist_reason("matched_sources"))
    )
    error = []
    if may_fail:
        error = [F.col("score_error").alias("error")]
        reason = reason.when(F.col("score_error").isNotNull(), ERROR_REASON)
    reason = reason.otherwise(F.lit(model_source))
    if mode == "batch":
        return judged.select(
            *kept,
            label.alias("label"),
            round4(confidence).alias("confidence"),
            (~hit & needs_review("confidence", low, high)).alias("needs_review"),
            reason.alias("source"),
            *error,
        )
    return judged.select(
        *kept,
        (label == HARASSMENT_LABEL).alias("is_nondeli"),
        label.alias("label"),
        confidence.alias("confidence"),
        reason.alias("reason"),
        F.when(~(empty | hit), individual(F.col("members"))).alias("individual_seeds"),
        *error,
    )
