"""Column functions on logits and probabilities held as arrays, one slot per class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterance_guard.functions.text import LABELS


def softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so that no exponential overflows."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Class id of the largest value; the first one on a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def label_name(class_id: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.get(F.array(*map(F.lit, labels)), class_id)


def label_id(name: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Class id of a name, null for an unknown name."""
    position = F.array_position(F.array(*map(F.lit, labels)), name)
    return F.nullif(position, F.lit(0)).cast("int") - 1


def probability_map(values: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, labels)), values)


def mean_of_arrays(arrays: Column, width: int = len(LABELS)) -> Column:
    """Slot-wise mean of an array of arrays."""

    def mean(slot: int) -> Column:
        total = F.aggregate(
            arrays, F.lit(0.0), lambda acc, values: acc + F.get(values, F.lit(slot))
        )
        return total / F.size(arrays)

    return F.array(*[mean(i) for i in range(width)])
