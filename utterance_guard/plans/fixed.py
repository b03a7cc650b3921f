"""Small lexicons and weights for the queries on the test tables.

The insults were picked by looking at the labels: they occur in toxic rows and nowhere else.
A high F1 with them shows that the parts fit together, not that a model is any good.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from utterance_guard.operators.scoring import OutsideScorer, WeightScorer
from utterance_guard.sources.files import PHRASE, make_lexicon

SUBSTRINGS = ("trash", "clown", "scum", "idiot", "worth", "worthless")
PHRASES = ("on scum", "in moron", "the loser", "trash idiot")
KEYWORDS = ("idiot", "Idiot", "moron", "loser", "Scum")

BIAS = {42: Decimal("-1.1000"), 123: Decimal("-0.9500"), 2024: Decimal("-1.3000")}

WEIGHTS = {
    "moron": ("2.4000", "2.1000", "2.6000"),
    "pathetic": ("1.9000", "2.2000", "1.7000"),
    "loser": ("2.0000", "1.6000", "2.3000"),
    "stupid": ("2.2000", "2.5000", "1.9000"),
    "disgusting": ("2.3000", "1.8000", "2.1000"),
    "the": ("-0.0200", "-0.0150", "-0.0220"),
    "of": ("0.0110", "0.0080", "0.0130"),
    "and": ("0.0170", "0.0210", "0.0140"),
    "is": ("0.0300", "0.0250", "0.0350"),
    "de": ("-0.0120", "-0.0100", "-0.0140"),
    "der": ("-0.0090", "-0.0130", "-0.0070"),
}

# pairs of characters, for the models of unspaced scripts
PAIRS = {
    "an": ("0.0110", "0.0090", "0.0120"),
    "th": ("-0.0100", "-0.0080", "-0.0130"),
    "e,": ("0.0200", "0.0150", "0.0170"),
    "ci": ("0.0050", "0.0060", "0.0040"),
    "ón": ("-0.0210", "-0.0180", "-0.0200"),
    "ör": ("0.0310", "0.0280", "0.0330"),
    "!!": ("0.4000", "0.3500", "0.4200"),
}

PATTERNS = {
    "ends_with_stop": r"\.\s*$",
    "question": r"\?",
    "masked": r"[*#%&$]{3}",
    "short": r"^.{1,80}$",
    "repeated_word": r"\bthe the\b",
}

THRESHOLDS = [i / 20 for i in range(1, 20)]


@lru_cache(maxsize=4)
def substring_lexicon(spark: SparkSession) -> DataFrame:
    return make_lexicon(spark, SUBSTRINGS, "list_a")


@lru_cache(maxsize=4)
def two_lexicons(spark: SparkSession) -> DataFrame:
    return substring_lexicon(spark).unionByName(make_lexicon(spark, PHRASES, "list_b", PHRASE))


@lru_cache(maxsize=4)
def scorer(spark: SparkSession) -> WeightScorer:
    return _scorer(spark, WEIGHTS, "word")


@lru_cache(maxsize=4)
def bigram_scorer(spark: SparkSession) -> WeightScorer:
    return _scorer(spark, PAIRS, "bigram")


NEW_YEAR = 1995

#: Enough for a fit to end by itself, and what its gradient may then be.
ROUNDS_TO_THE_END, SETTLED = 300, 1e-6

# Fixed value: the longest text that the stand-in for an outside model accepts.
OUTSIDE_CHARS = 400


def outside_scorer(longest: int | None = None) -> OutsideScorer:
    """The same weights behind Python functions; a text over ``longest`` is refused."""

    def loader(slot: int, bias: float) -> Callable:
        def load() -> Callable:
            word = regex.compile(r"\p{L}+")
            known = {token: float(ws[slot]) for token, ws in WEIGHTS.items()}

            def logits(texts: list[str]) -> np.ndarray:
                for t in texts:
                    if longest and len(t) > longest:
                        raise ValueError(f"{len(t)} characters")
                margins = [bias + sum(known.get(w, 0.0) for w in word.findall(t)) for t in texts]
                return np.stack([np.zeros(len(texts)), margins], axis=1)

            return logits

        return load

    return OutsideScorer({m: loader(i, float(b)) for i, (m, b) in enumerate(BIAS.items())})


def _scorer(spark: SparkSession, weights: dict, kind: str) -> WeightScorer:
    rows = [
        (member, token, Decimal(w))
        for token, ws in weights.items()
        for member, w in zip(BIAS, ws, strict=True)
    ]
    table = spark.createDataFrame(rows, "member INT, token STRING, w DECIMAL(18,4)")
    return WeightScorer(table, BIAS, kind=kind)
