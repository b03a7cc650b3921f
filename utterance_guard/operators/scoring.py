"""Scores of a text under several linear models, and their mean.

A scorer takes a DataFrame and the name of its text column and adds ``members``: an array,
in seed order, of ``seed, logits, probabilities, label, confidence``. Three scorers exist: a
table of token weights, fitted Spark ML models, and any outside model.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterance_guard.functions.probability import (
    argmax,
    label_name,
    mean_of_arrays,
    probability_map,
    softmax,
)
from utterance_guard.functions.text import LABELS, normalize, tokens
from utterance_guard.operators.sizes import fits_broadcast, rows_if_few, uses_that_fit
from utterance_guard.operators.stages import settle
from utterance_guard.session import cut_lineage

INLINE_TOKENS = 128


def with_members(
    df: DataFrame, logits: list[Column], seeds: list[int], labels: tuple[str, ...] = LABELS
) -> DataFrame:
    """Add ``members`` from one logits array per seed.

    The arrays get columns of their own: the optimizer does not fold a column into several
    places that use it, so each softmax is computed once.
    """
    held = df.withColumn("_logits", F.array(*logits))
    return _with_members(settle(held, _probs=F.transform("_logits", softmax)), seeds, labels)


def _with_members(df: DataFrame, seeds: list[int], labels: tuple[str, ...]) -> DataFrame:
    members = []
    for i, seed in enumerate(seeds):
        probabilities = F.get("_probs", F.lit(i))
        members.append(
            F.struct(
                F.lit(seed).alias("seed"),
                F.get("_logits", F.lit(i)).alias("logits"),
                probabilities.alias("probabilities"),
                label_name(argmax(probabilities), labels).alias("label"),
                F.array_max(probabilities).alias("confidence"),
            )
        )
    return df.withColumn("members", F.array(*members)).drop("_logits", "_probs")


@dataclass
class WeightScorer:
    """Linear models given as a table ``member, token, w`` and one bias per member.

    A vocabulary of up to ``inline_tokens`` becomes part of the projection, so that scoring
    shuffles nothing. A larger one is joined to the exploded tokens; partial sums leave one
    narrow row per text before the shuffle. Decimal weights are summed exactly: a join adds
    them as integers of their last digit, since a decimal sum makes an object per token.
    """

    weights: DataFrame
    bias: dict[int, Decimal | float]
    kind: str = "word"
    labels: tuple[str, ...] = LABELS
    inline_tokens: int = INLINE_TOKENS
    row_id: str = "row_id"
    can_broadcast: bool | None = None
    _few: dict[str, list] | None = field(init=False, repr=False)

    def __post_init__(self) -> None:
        usable = self.weights.filter(F.col("member").isin(list(self.bias)))
        rows = rows_if_few(usable, self.inline_tokens * len(self.bias))
        self._few = None if rows is None else {}
        for r in rows or []:
            sums = self._few.setdefault(r["token"], [0] * len(self.bias))
            sums[list(self.bias).index(r["member"])] += r["w"]

    def _wide(self) -> DataFrame:
        """One row per token, one column per member, in the units of ``_in_units``."""
        zero = F.lit(0).cast(self._sum_type)
        return self.weights.groupBy("token").agg(
            *[
                self._in_units(F.coalesce(
                    F.sum(F.when(F.col("member") == m, F.col("w"))).cast(self._sum_type), zero
                )).alias(self._name(m))
                for m in self.bias
            ]
        )

    @property
    def _digits(self) -> int | None:
        """Digits after the point of weights that 64 bits hold, else None."""
        kind = self._sum_type
        return kind.scale if isinstance(kind, T.DecimalType) and kind.precision <= 18 else None

    def _in_units(self, value: Column) -> Column:
        if self._digits is None:
            return value
        return (value * F.lit(Decimal(10**self._digits))).cast("long")

    def _from_units(self, total: Column) -> Column:
        if self._digits is None:
            return total.cast(self._sum_type)
        unit = F.lit(Decimal(1).scaleb(-self._digits))
        return (total.cast("decimal(19,0)") * unit).cast(self._sum_type)

    @staticmethod
    def _name(member: int) -> str:
        return f"w_{member}"

    @property
    def _sum_type(self) -> T.DataType:
        kind = self.weights.schema["w"].dataType
        if isinstance(kind, T.DecimalType):
            return T.DecimalType(18 if kind.scale < 10 else 38, kind.scale)
        return T.DoubleType()

    def _literal(self, value: Decimal | float) -> Column:
        return F.lit(value).cast(self._sum_type)

    def margins(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``margins``: bias plus the weight of every token, one slot per member. A text
        without a known token has the bias."""
        normal = df.withColumn("_tokens", tokens(F.col(text), self.kind))
        if self._few is not None:
            known = list(self._few)
            found = F.filter("_tokens", lambda t: t.isin(known))
            return (
                normal.withColumn("_found", F.transform(found, lambda t: self._table()[t]))
                .withColumn("margins", self._inline_margins())
                .drop("_tokens", "_found")
            )
        return self._joined_margins(normal).drop("_tokens")

    def _table(self) -> Column:
        if not self._few:
            empty = T.MapType(T.StringType(), T.ArrayType(self._sum_type))
            return F.create_map().cast(empty)
        return F.create_map(
            *[
                part
                for token, sums in self._few.items()
                for part in (F.lit(token), F.array(*map(self._literal, sums)))
            ]
        )

    def _inline_margins(self) -> Column:
        def margin(slot: int, bias: Decimal | float) -> Column:
            def add(total: Column, weights: Column) -> Column:
                return (total + F.get(weights, F.lit(slot))).cast(self._sum_type)

            return F.aggregate("_found", self._literal(bias), add)

        return F.array(*[margin(i, b) for i, b in enumerate(self.bias.values())])

    def _joined_margins(self, df: DataFrame) -> DataFrame:
        names = [self._name(m) for m in self.bias]
        # an inner explode would cut the tokens a second time, to filter texts without any
        exploded = df.select(self.row_id, F.explode_outer("_tokens").alias("token"))
        small = self.can_broadcast
        wide = self._wide()
        if small is None:
            small = fits_broadcast(wide)
        if small:
            found = exploded.join(F.broadcast(wide), "token")
        else:
            found = self._found(exploded, wide, names)
        sums = found.groupBy(self.row_id).agg(*[F.sum(n).alias(n) for n in names])
        return (
            df.join(sums, self.row_id, "left")
            .withColumn(
                "margins",
                F.array(
                    *[
                        (
                            F.coalesce(self._from_units(F.col(n)), self._literal(0))
                            + self._literal(b)
                        ).cast(self._sum_type)
                        for n, b in zip(names, self.bias.values(), strict=True)
                    ]
                ),
            )
            .drop(*names)
        )

    def _found(self, exploded: DataFrame, wide: DataFrame, names: list[str]) -> DataFrame:
        """Rows of a text that sum up to the weights of its tokens, where the vocabulary is too
        large to be broadcast.

        Most tokens of a corpus are few words: as many of the most used as may be broadcast are
        added up before anything is shuffled, and only the other tokens are joined by a shuffle.
        None of those is common enough to crowd a task. Uses are counted in the texts, unless
        the weights have a column ``uses``; the sums are the same with any.
        """
        if "uses" in self.weights.columns:
            known = F.coalesce(F.max("uses"), F.lit(1)).cast("long")
            uses = self.weights.groupBy("token").agg(known.alias("_uses"))
        else:
            uses = exploded.groupBy("token").agg(F.count("*").alias("_uses"))
        used = cut_lineage(wide.join(uses, "token"))
        least = uses_that_fit(used, "_uses")
        common = used.filter(F.col("_uses") >= least).drop("_uses")
        other = used.filter(F.col("_uses") < least).drop("_uses")
        known = F.broadcast(common.withColumn("_known", F.lit(True)))
        parts = cut_lineage(
            exploded.join(known, "token", "left")
            .groupBy(self.row_id, F.when(F.col("_known").isNull(), F.col("token")).alias("token"))
            .agg(F.count("*").alias("_times"), *[F.sum(n).alias(n) for n in names])
        )
        rest = parts.filter("token IS NOT NULL").drop(*names).join(other, "token")
        each = F.array_repeat(F.lit(0), F.col("_times").cast("int"))  # exact in every type
        rest = rest.select(self.row_id, *names, F.explode(each)).select(self.row_id, *names)
        return parts.filter("token IS NULL").select(self.row_id, *names).unionByName(rest)

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        logits = [
            F.array(F.lit(0.0), F.get("margins", F.lit(i)).cast("double"))
            for i in range(len(self.bias))
        ]
        return with_members(self.margins(df, text), logits, list(self.bias), self.labels).drop(
            "margins"
        )


@dataclass
class ModelScorer:
    """Fitted models, one per seed. Their transform is a projection: nothing is shuffled."""

    models: dict[int, PipelineModel]
    kind: str = "word"
    labels: tuple[str, ...] = LABELS

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        # the models have column names of their own: the caller's stay out of their way
        scored = df.select(
            F.struct(*df.columns).alias("_row"), tokens(F.col(text), self.kind).alias("tokens")
        )
        logits, probabilities = [], []
        for model in self.models.values():
            scored = model.transform(scored)
            last = model.stages[-1]
            logits.append(vector_to_array(last.getRawPredictionCol()))
            probabilities.append(vector_to_array(last.getProbabilityCol()))
        # whoever explodes the members filters on their number: not by scoring a second time
        settled = settle(scored, _logits=F.array(*logits), _probs=F.array(*probabilities))
        return _with_members(
            settled.select("_row.*", "_logits", "_probs"), list(self.models), self.labels
        )


@dataclass
class OutsideScorer:
    """Any model behind Python functions, one per seed. Each ``load`` runs once per worker and
    returns a function from a list of texts to an array of logits, one row per text. Null
    texts, which the lexicon has settled, are not shown to it and get logits of zero.

    A batch that raises ends the job, unless ``isolate`` is set: then it is halved until the
    texts that fail stand alone. Those get null logits, and so a null label and confidence, and
    what was raised in ``score_error``; the rest is scored. A model that cannot be loaded fails
    all texts of a batch, and is tried again at the next.
    """

    loaders: dict[int, Callable[[], Callable[[list[str]], np.ndarray]]]
    labels: tuple[str, ...] = LABELS
    scorer_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    isolate: bool = False

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        names = []
        batched = _isolated if self.isolate else _batched
        for seed, load in self.loaders.items():
            names.append(f"_logits_{seed}")
            made = batched(load, (self.scorer_id, seed), len(self.labels))
            df = df.withColumn(names[-1], made(F.col(text)))
        logits = [F.col(n) for n in names]
        if self.isolate:
            errors = [F.col(n)["error"] for n in names]
            logits = [F.when(F.coalesce(*errors).isNull(), F.col(n)["logits"]) for n in names]
            df = df.withColumn("score_error", F.coalesce(*errors))
        return with_members(df, logits, list(self.loaders), self.labels).drop(*names)


# Models that this worker process has loaded, by scorer and seed.
_LOADED: dict[tuple[str, int], Callable[[list[str]], np.ndarray]] = {}


def loaded(key: tuple[str, int], load: Callable) -> Callable[[list[str]], np.ndarray]:
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def _batched(load: Callable, key: tuple[str, int], classes: int):
    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            open_ = batch.notna().to_numpy()
            rows = np.zeros((len(batch), classes))
            if open_.any():
                rows[open_] = loaded(key, load)(batch[open_].tolist())
            yield pd.Series(list(rows))

    return logits


def _isolated(load: Callable, key: tuple[str, int], classes: int):
    def said(error: Exception) -> tuple[None, str]:
        return None, f"{type(error).__name__}: {error}"

    def tried(model: Callable, texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            return [(row, None) for row in np.asarray(model(texts), float)]
        except Exception as error:  # whatever a model may raise
            if len(texts) == 1:
                return [said(error)]
            half = len(texts) // 2
            return tried(model, texts[:half]) + tried(model, texts[half:])

    def scored(texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            model = loaded(key, load)
        except Exception as error:
            return [said(error)] * len(texts)
        return tried(model, texts)

    # not deterministic, so that a filter on the outcome does not ask the model a second time
    @F.pandas_udf("logits array<double>, error string")
    def outcome(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            open_ = np.flatnonzero(batch.notna().to_numpy())
            rows = [(np.zeros(classes), None)] * len(batch)
            if len(open_):
                for i, row in zip(open_.tolist(), scored(batch.iloc[open_].tolist())):
                    rows[i] = row
            yield pd.DataFrame(rows, columns=["logits", "error"])

    return outcome.asNondeterministic()


def isolated(scorer):
    """The same scorer, with the failure of one text kept from the others where it can fail."""
    return replace(scorer, isolate=True) if isinstance(scorer, OutsideScorer) else scorer


def with_ensemble(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Mean of the members' probabilities, then the best class. No vote: two narrow members
    lose against one that is sure."""
    averaged = settle(
        df, probabilities=mean_of_arrays(F.col("members.probabilities"), len(labels))
    )
    return averaged.withColumn(
        "label", label_name(argmax(F.col("probabilities")), labels)
    ).withColumn("confidence", F.array_max("probabilities"))


def ensemble_result(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``label, confidence, probabilities`` by name, and the members' own answers."""
    return with_ensemble(df, labels).withColumn(
        "result",
        F.struct(
            "label",
            "confidence",
            probability_map(F.col("probabilities"), labels).alias("probabilities"),
            individual(F.col("members")).alias("individual"),
        ),
    ).drop("probabilities", "label", "confidence")


def individual(members: Column) -> Column:
    return F.transform(
        members, lambda m: F.struct(m["seed"].alias("seed"), m["label"].alias("label"),
                                    m["confidence"].alias("confidence"))
    )


def member_rows(df: DataFrame, row_id: str = "row_id", *more: str) -> DataFrame:
    """One row per text and member: ``row_id, seed, margin, p0, p1, label, confidence``, and
    what ``more`` names."""
    return df.select(row_id, *more, F.explode("members").alias("m")).select(
        row_id,
        *more,
        F.col("m.seed").alias("seed"),
        (F.get("m.logits", F.lit(1)) - F.get("m.logits", F.lit(0))).alias("margin"),
        F.get("m.probabilities", F.lit(0)).alias("p0"),
        F.get("m.probabilities", F.lit(1)).alias("p1"),
        F.col("m.label").alias("label"),
        F.col("m.confidence").alias("confidence"),
    )


def ensemble_of_rows(scores: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The same mean over a table of ``row_id, seed, p0, p1`` that came from elsewhere."""
    averaged = scores.groupBy(row_id).agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1"))
    both = F.array("p0", "p1")
    return averaged.select(
        row_id,
        "p0",
        "p1",
        label_name(argmax(both)).alias("label"),
        F.array_max(both).alias("confidence"),
    )


def score_texts(df: DataFrame, scorer, text: str = "text") -> DataFrame:
    """Normalise, score and average: adds ``members, probabilities, label, confidence``."""
    return with_ensemble(score_members(df, scorer, text))


def score_members(df: DataFrame, scorer, text: str = "text") -> DataFrame:
    """Normalise and score: adds ``members``."""
    normal = df.withColumn("_normal_text", normalize(F.coalesce(F.col(text), F.lit(""))))
    return scorer.score(normal, "_normal_text").drop("_normal_text")
