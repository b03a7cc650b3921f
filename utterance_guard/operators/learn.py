"""Training, selection and evaluation of the classifier with Spark ML.

Each fit is distributed and uses every training row and every token: tokens are hashed into a
fixed number of features, so no vocabulary is cut or held anywhere. The driver loops over seeds
and candidates only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from utterance_guard.functions.probability import label_id
from utterance_guard.functions.text import normalize, seeded_hash, tokens
from utterance_guard.operators.curate import EVAL, EVAL_PERCENT, TRAIN, clean_labelled, split_hash
from utterance_guard.operators.metrics import METRICS, binary_metrics, class_weights
from utterance_guard.operators.scoring import (
    ModelScorer,
    WeightScorer,
    member_rows,
    score_members,
    score_texts,
)
from utterance_guard.session import cut_lineage
from utterance_guard.sources.files import append_history, history_row

# The seeds of the ensemble, in their order.
SEEDS = (42, 123, 2024)


@dataclass(frozen=True)
class Settings:
    """``decay`` and ``rounds`` are what selection varies; the rest describes the features.
    ``resample`` draws each seed's rows with replacement; without it a seed uses them all."""

    decay: float = 0.01
    rounds: int = 20
    kind: str = "word"
    features: int = 1 << 18
    balanced: bool = True
    resample: bool = False


CANDIDATES = tuple(
    Settings(decay=decay, rounds=rounds)
    for decay, rounds in ((0.1, 5), (0.1, 10), (0.01, 10), (0.01, 20), (0.001, 20))
)
PATIENCE = 2


def with_tokens(df: DataFrame, kind: str = "word") -> DataFrame:
    """Tokens of the normalised text, the same for training and prediction."""
    return df.withColumn("_normal", normalize(F.coalesce("text", F.lit("")))).select(
        *df.columns, tokens("_normal", kind).alias("tokens")
    )


def bootstrap_weight(seed: int, row_id: str = "row_id") -> Column:
    """How often a seed's resample holds a row: Poisson with mean 1, by a hash of the row, so
    that a lost task comes back with the same weights. The draw has 32 bits; the chances are
    summed until none of its values lies beyond."""
    draw = F.conv(F.substring(seeded_hash(seed, row_id), 17, 8), 16, 10).cast("double") / 2**32
    cumulative, total, term, k = [], 0.0, 0.36787944117144233, 0
    while total <= 1 - 2.0**-32:
        total, k = total + term, k + 1
        term /= k
        cumulative.append(total)
    return F.size(F.filter(F.array(*map(F.lit, cumulative)), lambda c: draw >= c)).cast("double")


def training_rows(df: DataFrame, seed: int, settings: Settings = Settings()) -> DataFrame:
    """Training rows with their ``weight``: the class's, times the resample's where the
    settings ask for one. Without a resample every row stays."""
    by_class = {
        r["label"]: r["weight"] for r in class_weights(df, balanced=settings.balanced).collect()
    }
    weight = F.when(F.col("label") == 1, by_class[1] or 0.0).otherwise(by_class[0] or 0.0)
    if not settings.resample:
        return df.withColumn("weight", weight)
    return df.withColumn("weight", weight * bootstrap_weight(seed)).filter("weight > 0")


def with_counts(tokenised: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Hashed counts in place of the tokens, for rows that are fitted: a fit passes over them
    several times, and they are a fraction of the tokens' size."""
    hashing = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=settings.features)
    return hashing.transform(tokenised).drop("tokens")


def fit(tokenised: DataFrame, seed: int, settings: Settings = Settings()) -> PipelineModel:
    """Fit one member on rows with ``row_id, label, tokens``, or with ``counts`` (of the same
    settings) for ``tokens``. The model takes tokens."""
    counts = f"counts_{seed}"
    hashing = HashingTF(inputCol="tokens", outputCol=counts, numFeatures=settings.features)
    rows = training_rows(tokenised, seed, settings)
    if "counts" in tokenised.columns:
        counted = rows.withColumnRenamed("counts", counts)
    else:
        counted = hashing.transform(rows)
    stages = [
        IDF(inputCol=counts, outputCol=f"features_{seed}"),
        LogisticRegression(
            featuresCol=f"features_{seed}",
            labelCol="label",
            weightCol="weight",
            rawPredictionCol=f"raw_{seed}",
            probabilityCol=f"probability_{seed}",
            predictionCol=f"prediction_{seed}",
            regParam=settings.decay,
            maxIter=settings.rounds,
            family="binomial",
        ),
    ]
    fitted = Pipeline(stages=stages).fit(counted.select("label", "weight", counts))
    return PipelineModel([hashing, *fitted.stages])


def fit_residual(
    model: PipelineModel, tokenised: DataFrame, seed: int, settings: Settings = Settings()
) -> DataFrame:
    """``feature, residual``: the gradient of the fitted loss for every feature that a training
    row has, and for the intercept as feature -1. At the optimum all are zero.

    The loss is the weighted mean of the log losses plus half the decay times the squares of
    the coefficients, in units of their feature's standard deviation. A task sums
    what its rows add per feature before anything is shuffled; the driver sees totals and the
    coefficients, of which there are as many as hashed features.
    """
    rows = training_rows(tokenised, seed, settings)
    fitted = model.stages[-1]
    off = vector_to_array(F.col(fitted.getProbabilityCol()))[1] - F.col("label")
    scored = model.transform(rows).select(
        "weight", (F.col("weight") * off).alias("pull"),
        F.unwrap_udt(fitted.getFeaturesCol()).alias("x"),
    )
    parts = scored.select(
        "weight", "pull", F.inline(F.arrays_zip(F.col("x.indices"), F.col("x.values")))
    ).toDF("weight", "pull", "feature", "value")
    sums = parts.groupBy("feature").agg(
        F.sum(F.col("pull") * F.col("value")).alias("pulled"),
        F.sum(F.col("weight") * F.col("value")).alias("once"),
        F.sum(F.col("weight") * F.col("value") ** 2).alias("twice"),
    )
    total = scored.agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") ** 2).alias("w2"),
        F.sum("pull").alias("pulled"),
    ).first()
    spark, mass = tokenised.sparkSession, total["w"]
    held = pd.DataFrame({"beta": fitted.coefficients.toArray()}).reset_index(names="feature")
    betas = spark.createDataFrame(held.astype({"feature": "int32"}))
    spread = F.sqrt(
        (F.col("twice") - F.col("once") ** 2 / mass) / (mass - total["w2"] / mass)
    )
    residual = F.when(spread > 0, F.col("pulled") / mass / spread
                      + fitted.getRegParam() * F.col("beta") * spread).otherwise(F.lit(0.0))
    own = sums.join(F.broadcast(betas), "feature").select(
        F.col("feature").cast("int").alias("feature"), residual.alias("residual")
    )
    level = spark.createDataFrame([(-1, total["pulled"] / mass)], "feature int, residual double")
    return own.unionByName(level)


def evaluate(
    models: dict[int, PipelineModel], df: DataFrame, expected: str = "label", kind: str = "word"
) -> DataFrame:
    """Metrics of the models' ensemble on any labelled set; of one model when given one."""
    return binary_metrics(judge(models, df, kind), expected, "predicted")


def judge(models: dict[int, PipelineModel], df: DataFrame, kind: str = "word") -> DataFrame:
    """Add ``predicted`` and ``confidence``."""
    kept = [c for c in df.columns if c not in ("label", "tokens")]
    renamed = df.withColumnRenamed("label", "_expected") if "label" in df.columns else df
    scored = score_texts(renamed, ModelScorer(models, kind))
    back = [F.col("_expected").alias("label")] if "label" in df.columns else []
    return scored.select(
        *kept, *back, label_id(F.col("label")).alias("predicted"), "confidence"
    )


def train_and_evaluate(
    labelled: DataFrame,
    seed: int,
    settings: Settings = Settings(),
    eval_percent: float = EVAL_PERCENT,
) -> tuple[PipelineModel, DataFrame]:
    """Clean, split by seed, fit on one side and measure on the other."""
    sides = split_hash(clean_labelled(labelled), seed, eval_percent)
    sides = cut_lineage(with_tokens(sides, settings.kind))
    model = fit(sides.filter(F.col("side") == TRAIN), seed, settings)
    metrics = evaluate({seed: model}, sides.filter(F.col("side") == EVAL), kind=settings.kind)
    return model, metrics.select(F.lit(seed).alias("seed"), *METRICS)


def select_best(
    train: DataFrame,
    evaluation: DataFrame,
    seed: int,
    candidates: Iterable[Settings] = CANDIDATES,
    patience: int = PATIENCE,
) -> tuple[PipelineModel, Settings, list[float]]:
    """Try candidates in turn and keep the one of best F1; stop after ``patience`` of them in
    a row bring no gain. The hashed or, where candidates differ in features, tokenised rows
    are shared by all fits, and the evaluation set by all measurements."""
    candidates = list(candidates)
    ready = with_tokens(train, candidates[0].kind)
    if len({c.features for c in candidates}) == 1:
        ready = with_counts(ready, candidates[0])
        kept = [c for c in ("row_id", "label", "counts") if c in ready.columns]
        ready = ready.select(*kept)
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    evaluation = evaluation.persist(StorageLevel.MEMORY_AND_DISK)
    best: tuple[PipelineModel, Settings] | None = None
    scores: list[float] = []
    top, waited = -1.0, 0
    try:
        for settings in candidates:
            model = fit(ready, seed, replace(settings, kind=candidates[0].kind))
            f1 = evaluate({seed: model}, evaluation, kind=settings.kind).first()["f1"]
            scores.append(f1)
            if f1 > top:
                best, top, waited = (model, settings), f1, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    finally:
        ready.unpersist()
        evaluation.unpersist()
    assert best is not None, "no candidates"
    return (*best, scores)


def multi_seed(
    labelled: DataFrame,
    evaluation: DataFrame,
    seeds: Iterable[int] = SEEDS,
    settings: Settings = Settings(),
) -> tuple[dict[int, PipelineModel], DataFrame]:
    """One model per seed, all measured on the same fixed set: the models, and a row of
    metrics per seed. The cleaned set is written once for all fits, as hashed counts and the
    sides of every seed, and the fixed set is read and scored once for all models."""
    ready = with_counts(with_tokens(clean_labelled(labelled), settings.kind), settings)
    sides = {seed: f"side_{seed}" for seed in seeds}
    for seed, side in sides.items():
        ready = split_hash(ready, seed).withColumnRenamed("side", side)
    ready = cut_lineage(ready.select("row_id", "label", "counts", *sides.values()))
    models = {}
    for seed, side in sides.items():
        models[seed] = fit(ready.filter(F.col(side) == TRAIN), seed, settings)
    held = evaluation.select("row_id", "text", F.col("label").alias("_expected"))
    rows = member_rows(
        score_members(held, ModelScorer(models, settings.kind)), "row_id", "_expected"
    ).withColumn("predicted", label_id(F.col("label")))
    metrics = binary_metrics(rows, "_expected", "predicted", by=("seed",))
    return models, metrics.select("seed", *METRICS)


def evaluate_and_record(
    models: dict[int, PipelineModel],
    evaluation: DataFrame,
    path: str,
    at: dt.datetime,
    train_rows: DataFrame | None = None,
    official: bool = True,
    kind: str = "word",
) -> DataFrame:
    """Measure on any labelled set (``expected_label``) and append a row to the history if the
    set is the official one; returns that row."""
    row = history_row(evaluate(models, evaluation, "expected_label", kind), train_rows, at)
    row = cut_lineage(row)
    append_history(row, path, official)
    return row


def export_weights(
    models: dict[int, PipelineModel], tokenised: DataFrame, kind: str = "word", **options
) -> WeightScorer:
    """The fitted models as a table ``member, token, uses, w`` of all distinct tokens of
    ``tokenised`` (column ``tokens``). A token weighs what the model adds for a text of that
    token alone, so tokens that share a hashed feature share its weight. The table is written,
    not collected."""
    each = tokenised.select(F.explode_outer("tokens").alias("token"))
    alone = each.groupBy("token").agg(F.count("*").alias("uses")).filter("token IS NOT NULL")
    alone = alone.select("token", "uses", F.array("token").alias("tokens"))
    bias = {seed: float(model.stages[-1].intercept) for seed, model in models.items()}
    weights = []
    for seed, model in models.items():
        alone = model.transform(alone)
        raw = vector_to_array(model.stages[-1].getRawPredictionCol())
        weights.append(
            F.struct(
                F.lit(seed).alias("member"),
                "token",
                "uses",
                (F.get(raw, F.lit(1)) - F.lit(bias[seed])).alias("w"),
            )
        )
    table = cut_lineage(alone.select(F.inline(F.array(*weights))))
    return WeightScorer(table, bias, kind=kind, **options)
