"""Curation of labelled sets: profile, dedupe, augmentation, splits, leakage.

Texts are compared by a 32-byte digest, so shuffles carry digests and row ids. Groups of equal
texts are only ever aggregated, with partial results before the shuffle: a text that makes up
a third of all rows is one row per task by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from utterance_guard.functions.text import (
    hash_percent,
    normalize,
    seeded_hash,
    strip,
    strip_punctuation,
    text_key,
)
from utterance_guard.session import cut_lineage
from utterance_guard.sources.contract import LABELLED, check_schema

# The reason given for augmented rows, and the share held for evaluation.
AUGMENT_REASON = "punctuation_stripped_augmentation"
EVAL_PERCENT = 15

TRAIN, EVAL = "train", "eval"


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Leave out rows without text or label. A blank text is a text."""
    return df.dropna(subset=["text", "label"])


def profile(df: DataFrame) -> DataFrame:
    """One row of counts: as read, with empty text, complete, distinct, repeats to remove."""
    complete = F.col("text").isNotNull() & F.col("label").isNotNull()
    per_text = (
        df.select(
            F.when(complete, text_key("text")).alias("key"),
            (F.col("text").isNull() | (strip("text") == "")).alias("is_empty"),
        )
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.count_if("is_empty").alias("n_empty"))
    )
    known = F.col("key").isNotNull()
    total = F.coalesce(F.sum("n"), F.lit(0))
    kept = F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))
    return per_text.agg(
        total.alias("n_rows"),
        F.coalesce(F.sum("n_empty"), F.lit(0)).alias("n_empty_text"),
        kept.alias("n_complete"),
        F.count_if(known).alias("n_distinct"),
        (kept - F.count_if(known)).alias("n_removed"),
    )


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def top_duplicates(df: DataFrame, k: int = 10, row_id: str = "row_id") -> DataFrame:
    """The ``k`` texts with most copies, ties in order of the text.

    Copies are counted by digest. Only texts that reach the k-th largest count are fetched,
    by the id of one copy each.
    """
    groups = (
        df.select(row_id, text_key("text").alias("key"))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min(row_id).alias(row_id))
        .filter("n > 1")
    )
    cutoff = groups.select("n").orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"))
    candidates = groups.filter(F.col("n") >= cutoff.scalar()).select(row_id, "n")
    return (
        df.select(row_id, "text")
        .join(candidates, row_id)
        .select("text", "n")
        .orderBy(F.desc("n"), "text")
        .limit(k)
    )


def dedupe_first(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """Keep the first row of each text by ``row_id``, which must be unique."""
    first = (
        df.select(row_id, text_key(text).alias("key"))
        .groupBy("key")
        .agg(F.min(row_id).alias(row_id))
    )
    return df.join(first.select(row_id), row_id, "left_semi")


def clean_labelled(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """What training starts from: complete rows, integer labels, one row per text."""
    complete = drop_incomplete(df).withColumn("label", F.col("label").cast("int"))
    return dedupe_first(complete, row_id)


def without_known(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``df`` whose text is not in ``known``, which is reduced to distinct digests."""
    seen = known.select(text_key("text").alias("_key")).distinct()
    return df.withColumn("_key", text_key("text")).join(seen, "_key", "left_anti").drop("_key")


def augment(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Copies without punctuation, as speech recognition would write them.

    No copy where nothing changes or the text exists already; of equal copies the first one
    stays, with its label. A copy's ``row_id`` is ``-1 - origin_id``: unique among copies, and
    apart from ids that are not negative.
    """
    stripped = df.withColumn("_bare", strip_punctuation("text")).filter("_bare != text")
    bare = stripped.select(row_id, F.col("_bare").alias("text"), "label")
    # equal copies all exist or all do not, so dropping the repeats first changes nothing and
    # keeps a frequent text from crowding one task of the anti join
    return without_known(dedupe_first(bare, row_id), df).select(
        (-1 - F.col(row_id)).alias(row_id),
        F.col(row_id).alias("origin_id"),
        "text",
        "label",
        F.lit(1.0).alias("confidence"),
        F.lit(AUGMENT_REASON).alias("reason"),
        F.lit(False).alias("needs_review"),
    )


def training_union(df: DataFrame, augmented: DataFrame) -> DataFrame:
    """Training set and augmented rows, in the training set's columns."""
    needed = T.StructType([f for f in LABELLED if f.name != "row_id"])
    check_schema(df, needed)
    check_schema(augmented, needed)
    return df.unionByName(augmented, allowMissingColumns=True).select(*df.columns)


def split_hash(
    df: DataFrame, seed: int, eval_percent: float = EVAL_PERCENT, text: str = "text"
) -> DataFrame:
    """Add ``side`` by a hash of seed and text. Row-local, and equal texts share a side."""
    share = hash_percent(seeded_hash(seed, text))
    return df.withColumn("side", F.when(share < eval_percent, EVAL).otherwise(TRAIN))


def split_exact(
    df: DataFrame,
    seed: int,
    eval_percent: int = EVAL_PERCENT,
    row_id: str = "row_id",
    prefix: int = 4,
) -> DataFrame:
    """Add ``side`` with exactly ``(percent * n + 50) div 100`` rows of each label in eval:
    those that come first by a hash of seed and row id.

    The cut is found without sorting a label. A histogram over the first ``prefix`` hex
    digits (65,536 bins, all alike in size, since row ids are unique) shows the bin where the
    cut falls, and only that bin is ranked. The cuts, one row per label, are broadcast; the
    rows themselves are read once and never shuffled.
    """
    keyed = cut_lineage(df.withColumn("_hash", seeded_hash(seed, row_id)))
    bins = (
        keyed.select("label", F.substring("_hash", 1, prefix).alias("bin"))
        .groupBy("label", "bin")
        .agg(F.count("*").alias("n"))
    )
    by_label = W.partitionBy("label")
    target = F.floor((F.lit(eval_percent) * F.sum("n").over(by_label) + 50) / 100)
    cut_bin = (
        bins.withColumn("target", target)
        .withColumn("upto", F.sum("n").over(by_label.orderBy("bin")))
        .filter((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("n") < F.col("target")))
        .select("label", "bin", (F.col("target") - F.col("upto") + F.col("n")).alias("need"))
    )
    ranked = (
        keyed.select("label", "_hash", F.substring("_hash", 1, prefix).alias("bin"))
        .join(F.broadcast(cut_bin), ["label", "bin"])
        .withColumn("rank", F.row_number().over(by_label.orderBy("_hash")))
    )
    cut = ranked.filter("rank = need").select("label", F.col("_hash").alias("cut"))
    return (
        keyed.join(F.broadcast(cut), "label", "left")
        .withColumn("side", F.when(F.col("_hash") <= F.col("cut"), EVAL).otherwise(TRAIN))
        .drop("_hash", "cut")
        .select(*df.columns, "side")
    )


def split_texts(
    df: DataFrame,
    seed: int,
    eval_percent: int = EVAL_PERCENT,
    text: str = "text",
    prefix: int = 4,
) -> DataFrame:
    """Add ``side`` so that equal texts share one and eval has as nearly the given percent of
    each label's rows as whole groups of texts allow.

    Groups are taken in order of a hash of seed and text, weighted by their rows, as long as
    that brings the share nearer. A group whose rows disagree counts under its smallest label;
    null texts are one group. The cut is found by a histogram over hash prefixes, and only
    the groups of one bin are summed in order. A text that is a third of all rows is one group
    throughout; Spark splits its key in the join that brings the sides to the rows.
    """
    digest = F.coalesce(seeded_hash(seed, text), F.lit(""))
    keyed = cut_lineage(df.withColumn("_hash", digest))
    groups = cut_lineage(
        keyed.groupBy("_hash")
        .agg(F.min("label").alias("stratum"), F.count("*").alias("n"))
        .withColumn("bin", F.substring("_hash", 1, prefix))
    )
    by_stratum = W.partitionBy("stratum")
    bins = (
        groups.groupBy("stratum", "bin")
        .agg(F.sum("n").alias("n"))
        .withColumn("share", F.sum("n").over(by_stratum) * eval_percent)
        .withColumn("before", F.sum("n").over(by_stratum.orderBy("bin")) - F.col("n"))
        .filter((F.col("before") * 100 <= F.col("share"))
                & (F.col("share") < (F.col("before") + F.col("n")) * 100))
        .select(F.col("stratum").alias("of"), F.col("bin").alias("cut_bin"), "share", "before")
    )
    # one row per label: a few numbers and the last hash that is taken
    inside = groups.join(
        F.broadcast(bins),
        F.expr("stratum <=> of AND bin = cut_bin"),
    ).select("stratum", "_hash", "n", "cut_bin", "share", "before")
    upto = F.col("before") + F.sum("n").over(by_stratum.orderBy("_hash")) - F.col("n")
    taken = (2 * upto + F.col("n")) * 100 <= 2 * F.col("share")
    cuts = cut_lineage(
        inside.withColumn("taken", taken)
        .groupBy(F.col("stratum").alias("of"), "cut_bin")
        .agg(F.max(F.when(F.col("taken"), F.col("_hash"))).alias("cut"))
    )
    sides = groups.join(F.broadcast(cuts), F.expr("stratum <=> of"), "left").select(
        "_hash",
        F.when(
            F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))
            | (F.col("_hash") <= F.col("cut")),
            EVAL,
        ).otherwise(TRAIN).alias("side"),
    )
    return keyed.join(cut_lineage(sides), "_hash").select(*df.columns, "side")


def compared_text(text: str = "text", loose: bool = False) -> Column:
    """Texts as they are, or (``loose``) without case, width and punctuation."""
    return strip_punctuation(normalize(text)) if loose else F.col(text)


def leaked_keys(evaluation: DataFrame, training: DataFrame, loose: bool = False) -> DataFrame:
    """Digests of evaluation texts that occur in training.

    Both sides are distinct before they meet. With a small evaluation set the optimizer
    broadcasts it and moves the semi join below the training side's aggregation.
    """
    text = compared_text(loose=loose)

    def digests(df: DataFrame) -> DataFrame:
        return df.select(text.alias("_t")).select(text_key("_t").alias("_key")).distinct()

    return digests(training).join(digests(evaluation), "_key", "left_semi")


def leakage(evaluation: DataFrame, training: DataFrame, loose: bool = False) -> DataFrame:
    """Evaluation rows whose text is also in training."""
    return _by_leak(evaluation, training, loose, "left_semi")


def remove_leakage(evaluation: DataFrame, training: DataFrame, loose: bool = False) -> DataFrame:
    """The evaluation set without them."""
    return _by_leak(evaluation, training, loose, "left_anti")


def _by_leak(
    evaluation: DataFrame, training: DataFrame, loose: bool, how: str
) -> DataFrame:
    keys = leaked_keys(evaluation, training, loose)
    keyed = evaluation.withColumn("_t", compared_text(loose=loose)).withColumn(
        "_key", text_key("_t")
    )
    return keyed.join(keys, "_key", how).select(*evaluation.columns)


def fresh_holdout(
    pool: DataFrame,
    training: DataFrame,
    earlier: DataFrame,
    period: int,
    percent: float = EVAL_PERCENT,
) -> DataFrame:
    """A new test set: a share of the pool, drawn by the period, that neither training nor an
    earlier test set contains. Each text once."""
    drawn = split_hash(pool, period, percent).filter(F.col("side") == EVAL).drop("side")
    unseen = remove_leakage(remove_leakage(drawn, training), earlier)
    return dedupe_first(unseen)
