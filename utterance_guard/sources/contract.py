"""Column contracts of the record sets, checked before a job starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG, INT, DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
STRING, BOOLEAN, TIMESTAMP = T.StringType(), T.BooleanType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


UTTERANCES = _schema(row_id=LONG, text=STRING)
LABELLED = _schema(row_id=LONG, text=STRING, label=INT)
AUGMENTED = _schema(
    row_id=LONG, text=STRING, label=INT, confidence=DOUBLE, reason=STRING, needs_review=BOOLEAN
)
EVALUATION = _schema(row_id=LONG, text=STRING, expected_label=INT)
LEXICON = _schema(source=STRING, ord=LONG, word=STRING, mode=STRING)
METRICS = _schema(seed=INT, accuracy=DOUBLE, precision=DOUBLE, recall=DOUBLE, f1=DOUBLE)
HISTORY = _schema(
    timestamp=TIMESTAMP,
    train_data_size=LONG,
    n_eval_samples=LONG,
    accuracy=DOUBLE,
    precision=DOUBLE,
    recall=DOUBLE,
    f1=DOUBLE,
)
SPEECH = _schema(speaker_id=LONG, ts=TIMESTAMP, text=STRING, is_final=BOOLEAN)

#: As a recogniser sends them: it numbers its results and sends them again as they change.
SPEECH_RESULTS = _schema(
    speaker_id=LONG, ts=TIMESTAMP, text=STRING, is_final=BOOLEAN, result_no=LONG
)


class SchemaMismatch(ValueError):
    pass


@dataclass(frozen=True)
class Drift:
    """What separates a schema from its contract."""

    missing: tuple[str, ...]
    extra: tuple[str, ...]
    retyped: tuple[tuple[str, str, str], ...]

    @property
    def clean(self) -> bool:
        return not (self.missing or self.extra or self.retyped)


def drift(df: DataFrame, contract: T.StructType) -> Drift:
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f.dataType.simpleString() for f in contract}
    return Drift(
        missing=tuple(c for c in wanted if c not in found),
        extra=tuple(c for c in found if c not in wanted),
        retyped=tuple(
            (c, wanted[c], found[c]) for c in wanted if c in found and wanted[c] != found[c]
        ),
    )


def check_schema(df: DataFrame, contract: T.StructType, allow_extra: bool = True) -> DataFrame:
    """``df`` itself if it keeps the contract. Nothing is read: only the schema is compared."""
    found = drift(df, contract)
    problems = []
    if found.missing:
        problems.append("missing: " + ", ".join(found.missing))
    if found.extra and not allow_extra:
        problems.append("unexpected: " + ", ".join(found.extra))
    problems += [f"{c} should be {w}, is {f}" for c, w, f in found.retyped]
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df
