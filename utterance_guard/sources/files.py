"""Readers and writers for utterances, lexicons, labelled sets, verdicts and metrics."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from utterance_guard.functions.text import nfkc, normalize, phrase_form, round4, strip
from utterance_guard.operators.sizes import fits_broadcast
from utterance_guard.session import cut_lineage
from utterance_guard.sources.contract import HISTORY, LEXICON, SPEECH, SchemaMismatch, check_schema

SUBSTRING, PHRASE = "substring", "phrase"

# Strings that a table reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def clean_utterances(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip every text and leave out the blank ones. Repeats stay."""
    return df.withColumn(text, strip(text)).filter(F.col(text) != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, value``: all lines, numbered from zero over the files in order of their paths.

    However the files are cut and packed into tasks, the numbers are the same. A first pass
    counts the lines that begin in each split, reading no text out of the scan; the counts, a
    row per split, are summed up in order; a second pass adds a line's place in its split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    splits = lines.groupBy("file", "start").agg(
        F.count("*").alias("n"), F.min("place").alias("first")
    )
    before = F.sum("n").over(W.orderBy("file", "start")) - F.col("n")
    offsets = cut_lineage(splits.select("file", "start", (before - F.col("first")).alias("offset")))
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    return lines.join(offsets, ["file", "start"]).select(
        (F.col("place") + F.col("offset")).alias("row_id"), "value"
    )


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """One utterance per line: ``row_id, text``. ``row_id`` is the number of the line over all
    files, blank ones counted, so sorting by it gives input order."""
    return clean_utterances(
        numbered_lines(spark, path).select("row_id", F.col("value").alias("text"))
    )


def spread_rows(df: DataFrame, row_id: str) -> DataFrame:
    """Hash a plain scan of fewer splits than cores over all of them by its row id; leave any
    other as it is. A small file of one row group would else be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, row_id)


def empty_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEXICON)


def lexicon_entries(lines: DataFrame, source: str, mode: str = SUBSTRING) -> DataFrame:
    """Lexicon from ``ord, value`` rows: strip, skip blank and ``#`` lines, then normalise.
    Phrases are cut into tokens as the texts will be."""
    entry = strip("value")
    return (
        lines.select("ord", entry.alias("entry"))
        .filter((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))
        .select(
            F.lit(source).alias("source"),
            F.col("ord").cast("long").alias("ord"),
            (F.btrim(phrase_form(nfkc("entry"))) if mode == PHRASE else normalize("entry")).alias(
                "word"
            ),
            F.lit(mode).alias("mode"),
        )
    )


def make_lexicon(
    spark: SparkSession, words: list[str] | tuple[str, ...], source: str, mode: str = SUBSTRING
) -> DataFrame:
    """Lexicon from words at hand, under the same rules as a file."""
    lines = spark.createDataFrame(list(enumerate(words)), "ord BIGINT, value STRING")
    return lexicon_entries(lines, source, mode)


def read_lexicon(
    spark: SparkSession, path: str, source: str, mode: str = SUBSTRING
) -> DataFrame:
    """Lexicon from a text file. A missing file gives a warning and no entries."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        warnings.warn(f"no lexicon at {path}: {source} has no entries", stacklevel=2)
        return empty_lexicon(spark)
    numbered = lines.select(F.monotonically_increasing_id().alias("ord"), "value")
    return lexicon_entries(numbered, source, mode)


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as strings, named by the header. A quoted field may hold line ends, which
    makes a file one task; turn ``multi_line`` off for big files without such fields."""
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def _require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaMismatch("missing: " + ", ".join(missing))


def _strict_int(value: Column, name: str, through: str = "int") -> Column:
    """Null stays null; anything else that is no number stops the job, ANSI mode or not."""
    number = value.try_cast(through)
    return F.when(
        value.isNotNull() & number.isNull(),
        F.raise_error(F.concat(F.lit(f"{name} is no number: "), value)).cast("int"),
    ).otherwise(number.cast("int"))


def read_labelled(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``row_id, text, label`` with NA words read as null. Rows without text or label are
    still there, for the profile; ``drop_incomplete`` takes them out."""
    raw = _read_csv(spark, path, multi_line)
    _require(raw, "text", "label")

    def known(c: str) -> Column:
        return F.when(~F.col(c).isin(*NA_TOKENS), F.col(c))

    return raw.select(
        F.monotonically_increasing_id().alias("row_id"),
        known("text").alias("text"),
        _strict_int(known("label"), "label", through="double").alias("label"),
    )


def read_eval(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    raw = _read_csv(spark, path, multi_line)
    _require(raw, "text", "expected_label")
    return raw.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("text"),
        F.coalesce(
            _strict_int(strip("expected_label"), "expected_label"),
            F.raise_error(F.lit("expected_label is empty")).cast("int"),
        ).alias("expected_label"),
    )


def write_csv(
    df: DataFrame, path: str, columns: list[str] | None = None, order_by: str | None = None
) -> None:
    """Overwrite ``path`` with a headed CSV in a fixed column order. ``order_by`` sorts the
    whole output, which costs a range shuffle; leave it out where order does not matter."""
    if order_by:
        df = df.orderBy(order_by)
    if columns:
        df = df.select(*columns)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def history_row(
    metrics: DataFrame, train_rows: DataFrame | None, at: dt.datetime
) -> DataFrame:
    """A history row from one row of ``binary_metrics``. ``train_rows`` is the training set as
    it is now; None where its file is absent gives a null size."""
    size = None if train_rows is None else train_rows.count()
    return metrics.select(
        F.lit(at).cast("timestamp").alias("timestamp"),
        F.lit(size).cast("long").alias("train_data_size"),
        F.col("n").cast("long").alias("n_eval_samples"),
        "accuracy",
        "precision",
        "recall",
        "f1",
    )


def append_history(
    metrics: DataFrame, path: str, official: bool = True, run_id: str | None = None
) -> bool:
    """Append a metrics row to the history, rounded to four digits, for the official set only.
    Returns whether anything was written.

    Each run has a folder of its own. With a ``run_id`` a job that is repeated writes its row in
    the place of the first: it is there once or, where every attempt was killed, not at all.
    """
    if not official:
        return False
    rounded = metrics.select(
        "timestamp",
        F.col("train_data_size").cast("long").alias("train_data_size"),
        F.col("n_eval_samples").cast("long").alias("n_eval_samples"),
        *[round4(m).alias(m) for m in ("accuracy", "precision", "recall", "f1")],
    )
    key = uuid.uuid4().hex if run_id is None else hashlib.sha256(run_id.encode()).hexdigest()
    check_schema(rounded, HISTORY).write.mode("overwrite").parquet(f"{path}/run={key}")
    return True


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path).select(*HISTORY.names)


def model_path(folder: str, seed: int) -> str:
    return f"{folder.rstrip('/')}/seed={seed}"


def save_model(model: PipelineModel, folder: str, seed: int) -> None:
    model.write().overwrite().save(model_path(folder, seed))


def load_models(folder: str, seeds: tuple[int, ...]) -> dict[int, PipelineModel]:
    """One fitted model per seed. A seed without a model is an error that names it."""
    models = {}
    for seed in seeds:
        path = model_path(folder, seed)
        try:
            models[seed] = PipelineModel.load(path)
        except Exception as error:
            raise FileNotFoundError(
                f"no model for seed {seed} at {path}; train that seed first"
            ) from error
    return models


def speech_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = SPEECH,
    **options: str,
) -> DataFrame:
    """Utterances as they arrive: files dropped into a folder. ``SPEECH_RESULTS`` is the schema
    of numbered results."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def speech_messages(messages: DataFrame) -> DataFrame:
    """Utterances out of a message queue's ``value`` column, each a JSON object."""
    fields = F.from_json(F.col("value").cast("string"), SPEECH.simpleString())
    return messages.select(fields.alias("m")).select("m.*")
