"""Measures of a classifier. Rows are reduced to counts first; ratios come from the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from utterance_guard.functions.probability import label_name
from utterance_guard.functions.text import HARASSMENT_LABEL

METRICS = ("accuracy", "precision", "recall", "f1")


def ratio(top: Column, bottom: Column) -> Column:
    """Zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def from_counts(counts: DataFrame, *keep: str) -> DataFrame:
    """Metrics from the columns ``tp, fp, fn, tn``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *keep,
        (tp + fp + fn + tn).alias("n"),
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def binary_metrics(
    df: DataFrame, expected: str = "expected_label", predicted: str = "predicted", by: tuple = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1, in total or per group."""
    e, p = F.col(expected), F.col(predicted)
    counts = df.groupBy(*by).agg(
        F.count_if((e == 1) & (p == 1)).alias("tp"),
        F.count_if((e == 0) & (p == 1)).alias("fp"),
        F.count_if((e == 1) & (p == 0)).alias("fn"),
        F.count_if((e == 0) & (p == 0)).alias("tn"),
    )
    return from_counts(counts, *by)


def mistakes(
    df: DataFrame, expected: str = "expected_label", predicted: str = "predicted"
) -> DataFrame:
    """Rows judged wrongly, with the names of both classes."""
    others = [c for c in df.columns if c not in (expected, predicted)]
    return df.filter(F.col(expected) != F.col(predicted)).select(
        *others,
        label_name(F.col(expected)).alias("expected"),
        label_name(F.col(predicted)).alias("predicted"),
    )


def verdict_summary(verdicts: DataFrame, *by: str | Column) -> DataFrame:
    """Verdicts, harassment among them, and those a person should see."""
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == HARASSMENT_LABEL).alias("n_harassment"),
        F.count_if("needs_review").alias("n_review"),
    )


def seed_summary(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation, least and most of each metric over the seeds."""
    long = metrics.unpivot([], list(METRICS), "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two experiments by their means over seeds. ``clear`` says that the change is larger
    than the pooled deviation, so it is not one seed's luck."""
    b = seed_summary(before).select(
        "metric", F.col("mean").alias("mean_before"), F.col("std").alias("std_before")
    )
    a = seed_summary(after).select(
        "metric", F.col("mean").alias("mean_after"), F.col("std").alias("std_after")
    )
    change = F.col("mean_after") - F.col("mean_before")
    pooled = F.sqrt((F.pow("std_before", F.lit(2)) + F.pow("std_after", F.lit(2))) / 2)
    return (
        b.join(a, "metric")
        .withColumn("change", change)
        .withColumn("pooled_std", pooled)
        .withColumn("clear", F.abs("change") > F.col("pooled_std"))
    )


def class_weights(df: DataFrame, label: str = "label", balanced: bool = True) -> DataFrame:
    """``label, n, weight`` of both classes in one pass; all weights 1 when not balanced."""
    totals = df.agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in (0, 1)])
    n = F.col("n0") + F.col("n1")
    weight = {
        c: F.try_divide(n, 2.0 * F.col(f"n{c}")) if balanced else F.lit(1.0) for c in (0, 1)
    }
    rows = [
        F.struct(F.lit(c).alias("label"), F.col(f"n{c}").alias("n"), weight[c].alias("weight"))
        for c in (0, 1)
    ]
    return totals.select(F.inline(F.array(*rows)))


def weighted_logloss(
    df: DataFrame, weights: DataFrame, label: str = "label", p1: str = "p1"
) -> DataFrame:
    """Weighted mean of the negative log of the true class's probability. The join is with
    one row per class."""
    p = F.when(F.col(label) == 1, F.col(p1)).otherwise(1 - F.col(p1))
    w = weights.select(F.col("label").alias(label), "weight")
    loss = F.sum(F.col("weight") * -F.ln(p)) / F.sum("weight")
    return df.join(w, label).agg(F.count("*").alias("n"), loss.alias("logloss"))


def threshold_sweep(
    df: DataFrame, thresholds: list[float], expected: str = "expected_label", p1: str = "p1"
) -> DataFrame:
    """Metrics at each threshold, positive from the threshold on.

    A row is counted once, under the number of thresholds it reaches. The rest is a running
    sum over at most ``len(thresholds) + 1`` rows, so no row is repeated per threshold.
    """
    cuts = sorted(set(thresholds))
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: F.col(p1) >= t))
    counted = (
        df.select(F.col(expected).alias("e"), reached.alias("reached"))
        .groupBy("reached")
        .agg(F.count_if(F.col("e") == 1).alias("pos"), F.count_if(F.col("e") == 0).alias("neg"))
    )
    steps = counted.sparkSession.createDataFrame(
        [(0, None)] + [(i + 1, float(t)) for i, t in enumerate(cuts)],
        "reached INT, threshold DOUBLE",
    )
    filled = steps.join(counted, "reached", "left").fillna(0, ["pos", "neg"])
    above = W.orderBy(F.desc("reached"))
    everything = W.partitionBy()
    counts = (
        filled.withColumn("tp", F.sum("pos").over(above))
        .withColumn("fp", F.sum("neg").over(above))
        .withColumn("fn", F.sum("pos").over(everything) - F.col("tp"))
        .withColumn("tn", F.sum("neg").over(everything) - F.col("fp"))
        .filter(F.col("threshold").isNotNull())
    )
    return from_counts(counts, "threshold")


def history_trend(history: DataFrame) -> DataFrame:
    """Each run against the one before. The table has one row per evaluation run."""
    by_time = W.orderBy("timestamp")
    return history.select(
        "*",
        *[(F.col(m) - F.lag(m).over(by_time)).alias(f"{m}_change") for m in METRICS],
    )


def best_candidate(metrics: DataFrame, patience: int = 2) -> DataFrame:
    """The row of best F1 among the rounds that early stopping would have run.

    ``metrics`` has one row per round: ``step`` counting from 1 and ``f1``. Rounds after
    ``patience`` rounds in a row without a gain do not count, nor does a tie displace an
    earlier round.
    """
    by_step = W.orderBy("step")
    best_before = F.max("f1").over(by_step.rowsBetween(W.unboundedPreceding, -1))
    marked = metrics.withColumn(
        "_gain", best_before.isNull() | (F.col("f1") > best_before)
    ).withColumn("_last", F.max(F.when(F.col("_gain"), F.col("step"))).over(by_step))
    # a round runs unless an earlier one ended the wait
    stopped_before = F.coalesce(
        F.max((F.col("step") - F.col("_last") >= patience).cast("int")).over(
            by_step.rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    run = marked.withColumn("_stopped", stopped_before).filter("_stopped = 0")
    return (
        run.filter("_gain")
        .orderBy(F.desc("step"))
        .limit(1)
        .select(*metrics.columns)
    )
