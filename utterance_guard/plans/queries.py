"""The registered queries: each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterance_guard.functions.probability import label_id, softmax
from utterance_guard.functions.text import (
    blocklist_reason,
    keyword_hit,
    normalize,
    strip_punctuation,
    tokens,
    truncate_tokens,
)
from utterance_guard.operators import curate, learn, metrics, review
from utterance_guard.operators.cascade import moderate
from utterance_guard.operators.lexicon import blocklist, blocklist_rows
from utterance_guard.operators.scoring import (
    ModelScorer,
    WeightScorer,
    member_rows,
    score_members,
    score_texts,
)
from utterance_guard.plans import fixed
from utterance_guard.session import cut_lineage, shared_folder
from utterance_guard.sources.files import (
    SUBSTRING,
    append_history,
    clean_utterances,
    history_row,
    read_history,
    read_utterances,
    spread_rows,
)
from utterance_guard.sources.store import merge_texts, read_store
from utterance_guard.streaming import alerts as speech
from utterance_guard.streaming import episodes

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(
    spark: SparkSession, folder: str, *more: str | Column, spread: bool = False
) -> DataFrame:
    """Documents as utterances: ``row_id, text``. ``spread`` is for queries that work hard on
    each text."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), "text", *more
    )
    return spread_rows(rows, "row_id") if spread else rows


def labelled(
    spark: SparkSession, folder: str, *more: str | Column, spread: bool = False
) -> DataFrame:
    """Documents with their label; null where nobody gave one."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("label")
    )
    return documents(spark, folder, *more, spread=spread).join(labels, "row_id", "left")


def labelled_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents judged once, written: with ``expected_label`` (null where nobody gave
    one) and ``predicted``."""
    rows = labelled(spark, folder, spread=True).withColumnRenamed("label", "expected_label")
    return cut_lineage(
        verdicts(spark, rows).withColumn("predicted", label_id(F.col("label")))
    )


def only_labelled(
    spark: SparkSession, folder: str, *more: str | Column, spread: bool = False
) -> DataFrame:
    return curate.drop_incomplete(labelled(spark, folder, *more, spread=spread))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document and conversation turn as speech: ``row_id`` numbers the
    line, the document or conversation is the speaker. A line without a full stop at its end
    is taken for an interim transcript."""
    texts = table(spark, folder, "documents").select(
        (F.col("doc_id") * 2).alias("speaker_id"), F.col("doc_id").alias("part"), "text"
    )
    spoken = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 2 + 1).alias("speaker_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("part"),
        "text",
    )
    cut = spread_rows(texts, "part").unionByName(spread_rows(spoken, "part")).select(
        "speaker_id", "part", F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    return cut.select(
        F.concat_ws("-", "speaker_id", "part", "line").alias("row_id"),
        "speaker_id",
        "text",
        F.endswith("text", F.lit(".")).alias("is_final"),
    )


def verdicts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return moderate(rows, fixed.two_lexicons(spark), fixed.scorer(spark))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return fixed.scorer(spark).score(
        documents(spark, folder, spread=True).withColumn("text", normalize("text")).select("row_id", "text")
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with the verdict's class: ``expected_label, predicted``. The
    document's own source is called ``area``, since a verdict has a ``source`` too."""
    rows = only_labelled(
        spark, folder, F.col("source").alias("area"), spread=True
    ).withColumnRenamed("label", "expected_label")
    return verdicts(spark, rows).withColumn("predicted", label_id(F.col("label")))


def member_judgements(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents under each member: ``row_id, seed, expected_label, p1``."""
    rows = only_labelled(spark, folder, spread=True).withColumn("text", normalize("text"))
    members = fixed.scorer(spark).score(rows)
    return members.select("row_id", F.col("label").alias("expected_label"),
                          F.explode("members").alias("m")).select(
        "row_id",
        F.col("m.seed").alias("seed"),
        "expected_label",
        F.get("m.probabilities", F.lit(1)).alias("p1"),
    )


def ensemble_judgements(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents under the ensemble: ``row_id, expected_label, p1``."""
    rows = only_labelled(spark, folder, spread=True).withColumnRenamed("label", "expected_label")
    return score_texts(rows, fixed.scorer(spark)).select(
        "row_id", "expected_label", F.get("probabilities", F.lit(1)).alias("p1")
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# text functions


def utterances_clean(spark: SparkSession, folder: str) -> DataFrame:
    lines = documents(spark, folder).select(
        "row_id", F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    return clean_utterances(lines)


def text_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("row_id", normalize("text").alias("normal_text"))


def punctuation_free(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("row_id", strip_punctuation("text").alias("text"))


def keyword_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "row_id", keyword_hit("text", fixed.KEYWORDS).alias("keyword")
    )


def token_truncate(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, spread=True).select(
        "row_id", normalize("text").alias("text")
    )
    toks = rows.select("row_id", tokens("text").alias("tokens"))
    kept = toks.select("row_id", "tokens", truncate_tokens("tokens").alias("kept"))
    return kept.select(
        "row_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size("kept").cast("long").alias("n_kept"),
        F.array_join("kept", " ").alias("input"),
    )


# lexicons


def blocklist_hits(spark: SparkSession, folder: str) -> DataFrame:
    matched = blocklist(documents(spark, folder, spread=True), fixed.substring_lexicon(spark))
    return matched.select(
        "row_id",
        "matched",
        F.array_join("matched_words", ",").alias("words"),
        F.when(F.col("matched"), blocklist_reason("matched_sources")).alias("reason"),
    )


def blocklist_two_sources(spark: SparkSession, folder: str) -> DataFrame:
    matched = blocklist(documents(spark, folder, spread=True), fixed.two_lexicons(spark))
    return blocklist_rows(matched)


def blocklist_hits_large(spark: SparkSession, folder: str) -> DataFrame:
    """A lexicon of some hundred words and more: all words of the benchmark texts."""
    items = table(spark, folder, "benchmark")
    words = (
        items.select("item_id", F.explode(tokens(normalize("text"))).alias("word"))
        .groupBy("word")
        .agg(F.min("item_id").alias("ord"))
    )
    lexicon = cut_lineage(
        words.select(F.lit("benchmark").alias("source"), "ord", "word",
                     F.lit(SUBSTRING).alias("mode"))
    )
    matched = blocklist(documents(spark, folder, spread=True), lexicon)
    return matched.select(
        "row_id",
        F.size("matched_words").cast("long").alias("n_hits"),
        F.md5(F.array_join("matched_words", ",")).alias("words_md5"),
    )


# scores


def member_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = member_rows(scored(spark, folder)).select("row_id", "seed", "margin", "p1")
    return rounded(rows, "margin", "p1")


def naive_bayes_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Log odds of each token per member, from the member's own training side."""
    rows = curate.clean_labelled(labelled(spark, folder))
    sides = {}
    for member in fixed.BIAS:
        rows = curate.split_hash(rows, member).withColumnRenamed("side", f"side_{member}")
        sides[member] = F.col(f"side_{member}") == curate.TRAIN
    words = rows.withColumn("normal", normalize("text")).select(
        "label",
        *[sides[m].alias(f"in_{m}") for m in sides],
        F.explode(F.array_distinct(tokens("normal"))).alias("token"),
    )
    # one pass over the tokens, one pair of sums per member
    sums = words.groupBy("token").agg(
        *[F.sum(F.when(F.col(f"in_{m}"), F.col("label"))).alias(f"toxic_{m}") for m in sides],
        *[F.count_if(f"in_{m}").alias(f"n_{m}") for m in sides],
    )
    each = [
        F.struct(
            F.lit(m).alias("member"),
            F.col(f"toxic_{m}").alias("toxic"),
            F.col(f"n_{m}").alias("n"),
        )
        for m in sides
    ]
    counts = sums.select("token", F.inline(F.array(*each))).filter("n > 0")
    odds = F.ln((F.col("toxic") + 1.0) / (F.col("n") - F.col("toxic") + 1.0))
    return counts.select("member", "token", F.round(odds, 4).cast("decimal(18,4)").alias("w"))


def member_scores_large(spark: SparkSession, folder: str) -> DataFrame:
    weights = cut_lineage(naive_bayes_weights(spark, folder))
    model = WeightScorer(weights, fixed.BIAS)
    rows = documents(spark, folder, spread=True).withColumn("text", normalize("text"))
    members = member_rows(model.score(rows)).select("row_id", "seed", "margin", "p1")
    return rounded(members, "margin", "p1")


def softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One distribution over the members, which also tests more than two classes."""
    margins = fixed.scorer(spark).margins(
        documents(spark, folder, spread=True).withColumn("text", normalize("text"))
    )
    logits = margins.select("row_id", F.col("margins").cast("array<double>").alias("z"))
    probabilities = logits.select("row_id", softmax(F.col("z")).alias("p"))
    return probabilities.select(
        "row_id", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(3)]
    )


def ensemble_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = score_texts(documents(spark, folder, spread=True), fixed.scorer(spark)).select(
        "row_id",
        F.get("probabilities", F.lit(0)).alias("p0"),
        F.get("probabilities", F.lit(1)).alias("p1"),
        "label",
        "confidence",
    )
    return rounded(rows, "p0", "p1", "confidence")


def member_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder).select("row_id", F.posexplode("members").alias("pos", "m"))
    return rounded(
        rows.select("row_id", "pos", F.col("m.seed").alias("seed"),
                    F.col("m.label").alias("label"), F.col("m.confidence").alias("confidence")),
        "confidence",
    )


# verdicts


def verdicts_batch(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(spark, documents(spark, folder, spread=True))


def verdicts_online(spark: SparkSession, folder: str) -> DataFrame:
    """Every line, blank ones included."""
    seeds = F.transform(
        "individual_seeds", lambda s: F.concat_ws(":", s["seed"].cast("string"), s["label"])
    )
    rows = lines(spark, folder).select("row_id", "text")
    online = moderate(rows, fixed.two_lexicons(spark), fixed.scorer(spark), "online")
    out = online.select(
        "row_id", "is_nondeli", "label", "confidence", "reason",
        F.array_join(seeds, ",").alias("seeds"),
    )
    return rounded(out, "confidence")


def verdict_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.verdict_summary(verdicts(spark, documents(spark, folder, spread=True)))


# curation


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return curate.profile(labelled(spark, folder))


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return curate.label_counts(curate.clean_labelled(labelled(spark, folder)))


def top_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return curate.top_duplicates(documents(spark, folder))


def labelled_clean(spark: SparkSession, folder: str) -> DataFrame:
    return curate.clean_labelled(labelled(spark, folder))


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    return curate.dedupe_first(documents(spark, folder))


def augment_rows(spark: SparkSession, folder: str) -> DataFrame:
    return curate.augment(only_labelled(spark, folder))


def training_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = curate.clean_labelled(labelled(spark, folder))
    return curate.training_union(rows, curate.augment(rows))


def split_hash(spark: SparkSession, folder: str) -> DataFrame:
    return curate.split_hash(documents(spark, folder), SEED).select("row_id", "side")


def split_exact(spark: SparkSession, folder: str) -> DataFrame:
    rows = curate.clean_labelled(labelled(spark, folder))
    return curate.split_exact(rows, SEED).select("row_id", "label", "side")


def _leak_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents stand for the evaluation set, the others for training."""
    rows = labelled(spark, folder)
    seen = F.col("label").isNotNull()
    return rows.filter(seen).select("row_id", "text"), rows.filter(~seen).select("row_id", "text")


def leakage(spark: SparkSession, folder: str) -> DataFrame:
    return curate.leakage(*_leak_sides(spark, folder))


def leakage_removed(spark: SparkSession, folder: str) -> DataFrame:
    return curate.remove_leakage(*_leak_sides(spark, folder), loose=True)


def fresh_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Drawn from all documents; the labelled ones and the last draw are taken."""
    pool = documents(spark, folder)
    training, _ = _leak_sides(spark, folder)
    earlier = curate.split_hash(pool, 202401).filter(F.col("side") == curate.EVAL)
    return curate.fresh_holdout(pool, training, earlier, 202402)


# metrics


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Of the training side."""
    rows = curate.split_hash(curate.clean_labelled(labelled(spark, folder)), SEED)
    train = rows.filter(F.col("side") == curate.TRAIN)
    return rounded(metrics.class_weights(train), "weight")


def weighted_logloss(spark: SparkSession, folder: str) -> DataFrame:
    rows = ensemble_judgements(spark, folder)
    weights = metrics.class_weights(rows, label="expected_label")
    return rounded(metrics.weighted_logloss(rows, weights, label="expected_label"), "logloss")


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.binary_metrics(judged(spark, folder)), *metrics.METRICS)


def mistakes(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mistakes(judged(spark, folder)).select(
        "row_id", "text", "expected", "predicted", "confidence"
    )


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    swept = metrics.threshold_sweep(ensemble_judgements(spark, folder), fixed.THRESHOLDS)
    return rounded(swept, *metrics.METRICS)


def _seed_metrics(judgements: DataFrame, threshold: float = 0.5) -> DataFrame:
    rows = judgements.withColumn("predicted", (F.col("p1") > threshold).cast("int"))
    return metrics.binary_metrics(rows, by=("seed",))


def seed_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = metrics.seed_summary(_seed_metrics(member_judgements(spark, folder)))
    return rounded(summary, "mean", "std", "min", "max")


def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Two settings of the decision threshold as two experiments."""
    judgements = cut_lineage(member_judgements(spark, folder))
    compared = metrics.compare_runs(
        _seed_metrics(judgements), _seed_metrics(judgements, threshold=0.6)
    )
    return rounded(compared, *[c for c, t in compared.dtypes if t == "double"])


def best_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds in rising order as rounds."""
    swept = metrics.threshold_sweep(ensemble_judgements(spark, folder), fixed.THRESHOLDS)
    rounds = swept.select(F.round(F.col("threshold") * 20).cast("int").alias("step"), "f1")
    return rounded(metrics.best_candidate(rounds), "f1")


def history_trend(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluation run per document source, a day apart."""
    runs = metrics.binary_metrics(judged(spark, folder), by=("area",))
    number = F.regexp_extract("area", r"\d+", 0).cast("int")
    history = runs.select(
        F.timestamp_seconds(F.lit(1_704_067_200) + number * 86_400).alias("timestamp"),
        *metrics.METRICS,
    )
    trend = metrics.history_trend(history)
    changes = [f"{m}_change" for m in metrics.METRICS]
    out = trend.select(
        F.unix_seconds("timestamp").alias("unix_time"), *metrics.METRICS, *changes
    )
    return rounded(out, *metrics.METRICS, *changes)


# review


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled_verdicts(spark, folder)
    return review.review_queue(rows, rows.filter("expected_label != predicted"))


def error_patterns(spark: SparkSession, folder: str) -> DataFrame:
    wrong = judged(spark, folder).filter("expected_label != predicted")
    return review.error_patterns(wrong, fixed.PATTERNS)


def suspect_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(judged(spark, folder))
    return rounded(review.suspect_words(rows), "share", "overall")


def error_by_area(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(review.error_by_area(judged(spark, folder), "area"), "error_share")


def monthly_review(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dated by the order of the same number; those without one have no month."""
    dates = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("ts")
    )
    rows = labelled_verdicts(spark, folder).join(dates, "row_id", "left")
    return review.monthly_review(
        rows.filter("needs_review"), rows.filter("expected_label != predicted")
    )


# streams, in batch form


def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    out = speech.alerts(
        lines(spark, folder), fixed.two_lexicons(spark), fixed.scorer(spark), fixed.KEYWORDS
    )
    return out.select("row_id", "speaker_id", "keyword", "is_nondeli", "reason", "alert")


def alert_episodes(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("speaker_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    return speech.episodes_batch(events, gap_seconds=7200).select(
        "speaker_id",
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
        "n_alerts",
    )


def daily_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dated by the event of the same number."""
    dates = table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    dated = verdicts(spark, documents(spark, folder, spread=True)).join(dates, "row_id")
    daily = speech.windowed_verdicts(dated)
    return daily.select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "n_harassment", "n_review"
    )


# learning


def train_eval(spark: SparkSession, folder: str) -> DataFrame:
    _, result = learn.train_and_evaluate(labelled(spark, folder), SEED)
    return rounded(result, *metrics.METRICS)


def multi_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on labelled documents outside a fixed tenth, measured on that tenth."""
    rows = curate.split_hash(curate.clean_labelled(labelled(spark, folder)), 7, 10.0)
    train = rows.filter(F.col("side") == curate.TRAIN).drop("side")
    held = rows.filter(F.col("side") == curate.EVAL).drop("side")
    _, result = learn.multi_seed(train, held)
    return rounded(result, *metrics.METRICS)


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that a seed's training uses, with the weight it has there."""
    rows = curate.split_hash(curate.clean_labelled(labelled(spark, folder)), SEED)
    train = cut_lineage(rows.filter(F.col("side") == curate.TRAIN))
    out = learn.training_rows(train, SEED).select("row_id", "label", "side", "weight")
    return rounded(out, "weight")


def export_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Documents on which a fitted model and its exported weights differ."""
    rows = curate.split_hash(curate.clean_labelled(labelled(spark, folder)), SEED)
    settings = learn.Settings(rounds=5)
    train = learn.with_tokens(rows.filter(F.col("side") == curate.TRAIN))
    train = cut_lineage(learn.with_counts(train, settings).select("row_id", "label", "counts"))
    models = {SEED: learn.fit(train, SEED, settings)}
    # texts are cut again by whoever needs tokens: written, those take several times the space
    docs = documents(spark, folder, spread=True)
    exported = learn.export_weights(models, learn.with_tokens(docs))
    own = member_rows(score_members(docs, ModelScorer(models)))
    other = member_rows(score_members(docs, exported))
    both = own.select("row_id", "p1").join(
        other.select("row_id", F.col("p1").alias("exported")), "row_id", "full"
    )
    gap = F.coalesce(F.abs(F.col("p1") - F.col("exported")), F.lit(1.0))
    return both.filter(gap > 1e-9).select("row_id")


def tokens_bigram(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder, spread=True).select("row_id", normalize("text").alias("t"))
    toks = rows.select("row_id", tokens("t", "bigram").alias("tokens"))
    return toks.select(
        "row_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", "|")).alias("tokens_md5"),
    )


def member_scores_bigram(spark: SparkSession, folder: str) -> DataFrame:
    """The scoring of unspaced scripts: weights of character pairs."""
    rows = documents(spark, folder, spread=True).withColumn("text", normalize("text"))
    scored_rows = member_rows(fixed.bigram_scorer(spark).score(rows))
    return rounded(scored_rows.select("row_id", "seed", "margin", "p1"), "margin", "p1")


# more ways in and out


def outside_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a model behind Python functions, loaded once per worker."""
    rows = documents(spark, folder, spread=True)
    members = member_rows(score_members(rows, fixed.outside_scorer()))
    return rounded(members.select("row_id", "seed", "margin", "p1"), "margin", "p1")


def alerts_with_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts while the model refuses long texts: those have an error and their keyword check."""
    out = speech.alerts(
        lines(spark, folder),
        fixed.two_lexicons(spark),
        fixed.outside_scorer(fixed.OUTSIDE_CHARS),
        fixed.KEYWORDS,
    )
    return out.select("row_id", "keyword", "is_nondeli", "reason", "alert", "error")


def latest_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a numbered result: its first line as an interim transcript, then the whole
    turn as the final one, all of it sent twice."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("speaker_id"), F.col("turn").cast("long").alias("result_no"),
        F.timestamp_seconds(F.col("turn") * 10).alias("ts"), "text",
    )
    interim = turns.withColumns({
        "text": F.substring_index("text", "\n", 1), "is_final": F.lit(False)
    })
    final = turns.withColumns({
        "ts": F.col("ts") + F.expr("INTERVAL 2 SECONDS"), "is_final": F.lit(True)
    })
    sent = interim.unionByName(final)
    latest = speech.latest_results(sent.unionByName(sent))
    return latest.select(
        "speaker_id", "result_no", "is_final", F.md5("text").alias("text_md5"),
        keyword_hit("text", fixed.KEYWORDS).alias("keyword"),
    )


def episode_signals(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("speaker_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    both = episodes.episode_signals_batch(events, gap_seconds=7200)
    return both.select(
        "speaker_id", "signal", F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"), "n_alerts",
    )


def utterance_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as text files in order, read again as utterances."""
    path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    documents(spark, folder).orderBy("row_id").select(F.coalesce("text", F.lit(""))).write.text(path)
    return read_utterances(spark, path)


def split_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with all their copies."""
    rows = only_labelled(spark, folder)
    return curate.split_texts(rows, SEED).select("row_id", "label", "side")


def history_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Two evaluation runs, of which the first is repeated: a row each."""
    path = f"{shared_folder(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    result = cut_lineage(metrics.binary_metrics(judged(spark, folder)))
    for run, hour in (("first", 1), ("first", 1), ("second", 2)):
        at = dt.datetime(2024, 1, 1, hour, tzinfo=dt.timezone.utc)
        append_history(history_row(result, None, at), path, run_id=run)
    rows = read_history(spark, path)
    return rows.select(
        F.unix_seconds("timestamp").alias("unix_time"), "n_eval_samples", *metrics.METRICS
    )


def mined_endings(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(review.mined_endings(judged(spark, folder)), "share")


def training_store(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents and their augmented copies merged into a stored set, the copies twice."""
    path = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    rows = cut_lineage(
        curate.clean_labelled(labelled(spark, folder)).select("row_id", "text", "label")
    )
    merge_texts(rows, path)
    copies = curate.augment(rows).select(*rows.columns)
    for _ in range(2):
        merge_texts(copies, path)
    return read_store(spark, path, rows.schema).select(*rows.columns)


def fit_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Features whose weight a fit that ran to its end has not settled: none."""
    rows = curate.split_hash(curate.clean_labelled(labelled(spark, folder)), SEED)
    train = cut_lineage(learn.with_tokens(rows.filter(F.col("side") == curate.TRAIN)))
    settings = learn.Settings(rounds=fixed.ROUNDS_TO_THE_END)
    left = learn.fit_residual(learn.fit(train, SEED, settings), train, SEED, settings)
    return left.filter(F.abs("residual") > fixed.SETTLED)


def selection_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates are fitted in turn; a row if the one that was kept is not the one that their
    scores name."""
    rows = curate.split_hash(curate.clean_labelled(labelled(spark, folder)), SEED)
    rows = cut_lineage(rows)
    sides = [rows.filter(F.col("side") == s).drop("side") for s in (curate.TRAIN, curate.EVAL)]
    _, kept, scores = learn.select_best(*sides, SEED)
    rounds = spark.createDataFrame(list(enumerate(scores)), "step int, f1 double")
    named = metrics.best_candidate(rounds).select("step")
    return named.filter(F.col("step") != learn.CANDIDATES.index(kept))


def new_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Wrongly judged documents, dated by the order of the same number, before and after 1995."""
    dates = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.year("o_orderdate") >= fixed.NEW_YEAR).alias("is_new"),
    )
    wrong = judged(spark, folder).filter("expected_label != predicted")
    return review.new_areas(wrong.join(dates, "row_id"))


QUERIES: tuple[Query, ...] = (
    utterances_clean, text_normalized, punctuation_free, keyword_alerts, token_truncate,
    blocklist_hits, blocklist_two_sources, blocklist_hits_large,
    member_scores, member_scores_large, softmax_scores, ensemble_scores, member_breakdown,
    verdicts_batch, verdicts_online, verdict_summary,
    profile, label_counts, top_duplicates, labelled_clean, dedupe_first, augment_rows,
    training_union, split_hash, split_exact, leakage, leakage_removed, fresh_holdout,
    class_weights, weighted_logloss, binary_metrics, mistakes, threshold_sweep, seed_summary,
    run_comparison, best_candidate, history_trend,
    review_queue, error_patterns, suspect_words, error_by_area, monthly_review,
    stream_alerts, alert_episodes, daily_verdicts,
    train_eval, multi_seed, training_rows, export_gap, tokens_bigram, member_scores_bigram,
    outside_scores, alerts_with_failures, latest_transcripts, episode_signals, utterance_lines,
    split_texts, history_runs, mined_endings, training_store, fit_residual, selection_gap,
    new_areas,
)


def registered() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
