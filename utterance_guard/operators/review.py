"""Upkeep after deployment: the review queue, error patterns, suspect words, areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from utterance_guard.functions.text import normalize, strip, tokens
from utterance_guard.operators.metrics import ratio
from utterance_guard.session import cut_lineage

# The rules of thumb for acting on errors.
QUEUE_READY = 20
PATTERN_MINIMUM = 3
ADD_PAIRS, WATCH = "add 15-40 minimal pairs", "watch"


def review_queue(
    verdicts: DataFrame, reports: DataFrame, ready_at: int = QUEUE_READY
) -> DataFrame:
    """Flagged verdicts and reported errors, with a mark once the batch is worth a session.
    A row both flagged and reported comes twice, once for each origin."""
    flagged = verdicts.filter("needs_review").select(
        "row_id", "text", "label", "confidence", F.lit("flagged").alias("origin")
    )
    reported = reports.select(
        "row_id", "text", "label", "confidence", F.lit("reported").alias("origin")
    )
    queue = flagged.unionByName(reported)
    size = queue.agg(F.count("*").alias("n"))
    return queue.withColumn("ready", size.scalar() >= ready_at)


def error_patterns(
    errors: DataFrame, patterns: dict[str, str], minimum: int = PATTERN_MINIMUM
) -> DataFrame:
    """Errors per pattern (name -> regular expression), and what to do about each. A text
    may fall under several patterns; patterns without an error are left out."""
    names = F.array_compact(
        F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in patterns.items()])
    )
    return (
        errors.select(F.explode(names).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count("*").alias("n"))
        .withColumn("action", F.when(F.col("n") >= minimum, ADD_PAIRS).otherwise(WATCH))
    )


def mined_endings(
    judged: DataFrame,
    longest: int = 6,
    minimum: int = PATTERN_MINIMUM,
    expected: str = "expected_label",
    predicted: str = "predicted",
) -> DataFrame:
    """Endings of up to ``longest`` characters that at least ``minimum`` wrong rows share, with
    the rows that have them at all, and what to do about each. An ending is left out where one
    that is a character longer ends just as many wrong rows: that one says more.

    A row gives one narrow row per ending, and they are counted in each task first.
    """
    whole = strip(F.coalesce("text", F.lit("")))
    sizes = F.sequence(F.lit(1), F.least(F.char_length("_text"), F.lit(longest)))
    ended = (
        judged.select(whole.alias("_text"),
                      (F.col(expected) != F.col(predicted)).cast("long").alias("wrong"))
        .filter("_text <> ''")
        .select("wrong", F.explode(F.transform(sizes, lambda n: F.right("_text", n))).alias("ending"))
    )
    counted = (
        ended.groupBy("ending")
        .agg(F.count("*").alias("n"), F.sum("wrong").alias("n_wrong"))
        .filter(F.col("n_wrong") >= minimum)
    )
    explained = (
        counted.filter(F.char_length("ending") > 1)
        .groupBy(F.expr("substring(ending, 2)").alias("ending"))
        .agg(F.max("n_wrong").alias("most"))
    )
    return (
        counted.join(explained, "ending", "left")
        .filter(F.coalesce("most", F.lit(0)) < F.col("n_wrong"))
        .select("ending", "n", "n_wrong", ratio(F.col("n_wrong"), F.col("n")).alias("share"),
                F.lit(ADD_PAIRS).alias("action"))
    )


# An approximation of erfc by Abramowitz and Stegun, 7.1.26. It is a little too
# large far out, which makes the test a little too strict there.
ERFC_T, ERFC = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def chi_squared_tail(x: Column) -> Column:
    """The chance of a chi-squared value (one degree of freedom) above ``x``."""
    t = 1 / (1 + ERFC_T * F.sqrt(x / 2))
    total = F.lit(0.0)
    for factor in reversed(ERFC):
        total = (total + factor) * t
    return total * F.exp(-x / 2)


def log_likelihood_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a among c against b among d: twice the gain in log likelihood by two rates."""

    def part(seen: Column, total: Column, share: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / (total * share))).otherwise(F.lit(0.0))

    share = (a + b) / (c + d)
    rest = 1 - share
    return 2 * (part(a, c, share) + part(b, d, share) + part(c - a, c, rest) + part(d - b, d, rest))


def new_areas(
    wrong: DataFrame,
    is_new: str = "is_new",
    support: int = 3,
    false_discoveries: float = 0.05,
    kind: str = "word",
) -> DataFrame:
    """Words that the wrong rows of a new period have more often than those of the period
    before: ``word, n_new, n_old, ratio, new_area``, for words of at least ``support`` wrong
    rows.

    Rates are compared by their log-likelihood ratio; the share of false ones among those marked
    is held by the step-up rule of Benjamini and Hochberg. Its ranks come from a histogram of the
    ratios in steps of a hundredth, taken at the lower end of each step, so no word list is
    sorted whole. Rows without a period are left out.
    """
    rows = wrong.filter(F.col(is_new).isNotNull()).withColumn("_normal", normalize("text"))
    total = rows.agg(F.count_if(F.col(is_new)).alias("c"), F.count_if(~F.col(is_new)).alias("d"))
    c, d = (total.select(n).scalar().cast("double") for n in ("c", "d"))
    counted = (
        rows.select(is_new, F.explode(F.array_distinct(tokens("_normal", kind))).alias("word"))
        .groupBy("word")
        .agg(F.count_if(F.col(is_new)).alias("n_new"), F.count_if(~F.col(is_new)).alias("n_old"))
        .filter(F.col("n_new") + F.col("n_old") >= support)
        .withColumns({"c": c, "d": d})
    )
    a, b = F.col("n_new").cast("double"), F.col("n_old").cast("double")
    one_period = (F.col("c") == 0) | (F.col("d") == 0)
    ratio_ = F.when(one_period, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.round(log_likelihood_ratio(a, b, F.col("c"), F.col("d")), 6))
    )
    tested = cut_lineage(
        counted.withColumn("ratio", ratio_).withColumn("step", F.floor(F.col("ratio") * 100))
    )
    steps = tested.groupBy("step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy(F.desc("step")))
    ranked = steps.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy())})
    chance = chi_squared_tail(F.col("step") / 100)
    held = ranked.filter(chance <= false_discoveries * F.col("upto") / F.col("all"))
    cut = held.agg(F.min("step").alias("cut")).scalar()
    more = F.col("n_new") * F.col("d") > F.col("n_old") * F.col("c")
    return tested.select(
        "word", "n_new", "n_old", "ratio",
        F.coalesce((F.col("step") >= cut) & more, F.lit(False)).alias("new_area"),
    )


def suspect_words(
    judged: DataFrame,
    expected: str = "expected_label",
    predicted: str = "predicted",
    support: int = 5,
    lift: float = 2.0,
    kind: str = "word",
) -> DataFrame:
    """Words whose texts are wrongly called positive more often than texts at large: at least
    ``support`` texts with the word, and ``lift`` times the overall share of such errors."""
    wrong = ((F.col(expected) == 0) & (F.col(predicted) == 1)).cast("int")
    rows = judged.withColumn("_normal", normalize("text")).select(
        wrong.alias("wrong"), F.array_distinct(tokens("_normal", kind)).alias("words")
    )
    overall = judged.agg(ratio(F.sum(wrong), F.count("*")).alias("share"))
    return (
        rows.select("wrong", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("wrong").cast("long").alias("n_wrong"))
        .filter((F.col("n") >= support) & (F.col("n_wrong") > 0))
        .withColumn("share", ratio(F.col("n_wrong"), F.col("n")))
        .withColumn("overall", overall.scalar())
        .filter(F.col("share") >= lift * F.col("overall"))
    )


def error_by_area(
    judged: DataFrame,
    area: str | Column,
    expected: str = "expected_label",
    predicted: str = "predicted",
) -> DataFrame:
    """Error share per area, for instance a source or a language."""
    wrong = F.count_if(F.col(expected) != F.col(predicted))
    return judged.groupBy(area).agg(
        F.count("*").alias("n"),
        wrong.alias("n_wrong"),
        ratio(wrong, F.count("*")).alias("error_share"),
    )


def monthly_review(flagged: DataFrame, reported: DataFrame, ts: str = "ts") -> DataFrame:
    """Flagged rows and reported errors per month."""
    month = F.date_format(F.date_trunc("month", F.col(ts)), "yyyy-MM").alias("month")
    both = flagged.select(month, F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(
        reported.select(month, F.lit(0).alias("f"), F.lit(1).alias("r"))
    )
    return both.groupBy("month").agg(
        F.sum("f").alias("n_flagged"), F.sum("r").alias("n_reported")
    )
