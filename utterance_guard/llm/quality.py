"""Quality classifier from weak labels.

Heuristic labellers look at each text and vote good, bad, or not at all. Two latent-class
models, one of form and one of abuse, are fitted by expectation-maximisation: they estimate how
accurate each labeller is from where labellers overlap, with no true labels, and turn votes
into the probability that a text is bad. These posterior labels train a linear scorer over
hashed features (words that occur, and the measures that labellers look at, by level). The
scorer decides: a document is kept if its probability of being bad is below one half.

Votes are counted over all documents; what EM works on is the number of documents per vote
pattern, of which there are at most 3^11. The word list of the abuse labellers comes from up to
``LABELLED_ROWS`` labelled rows: words that occur in many toxic ones and hardly anywhere else,
dealt in turn to three labellers. The scorer is fitted on the ``TRAINING_ROWS`` or so documents
whose ids hash lowest. Both bounds are parameters; neither limits what is scored.

Defined results: a text without words is bad, null is such a text. Rows are judged one by one,
so repeated rows get the same answer. Labels that are null, or of unknown documents, are not
used; without toxic labels there is no word list. With an empty table all results are empty,
and a scorer without training rows rejects only texts without words. Columns of the documents
are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterance_guard.llm.common import LOWER, small_batches, text_bytes, written

LABELLED_ROWS = 20_000
TRAINING_ROWS = 20_000
#: A word for the abuse labellers: in this share of toxic texts, at least, and so rarely elsewhere.
TOXIC_SHARE, TOXIC_PRECISION, TOXIC_LEAST = 0.05, 0.95, 3
BUCKETS = 1 << 18
WINDOW = 50
ENDS = b".!?"
PLAIN_TAILS = frozenset(b".,;:!?\"')-")
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
LETTERS = UPPER + bytes(range(97, 123))
ABSTAIN, GOOD, BAD = 0, 1, 2

#: Measures of form with their limits: good up to the first, bad from the second; the other way
#: round where the first is larger.
MEASURES = (
    ("marked", 0.05, 0.3),  # words that end in a mark that is not punctuation
    ("upper", 0.2, 0.5),  # capital letters among letters
    ("bare", 0.05, 0.2),  # words without a letter or digit at either end
    ("distinct", 0.6, 0.35),  # distinct words within windows
    ("loud", 0.1, 0.3),  # words that end in an exclamation mark
    ("flat", 0.985, 0.999),  # words that don't end a sentence
    ("symbols", 0.01, 0.04),  # bytes that are neither letters, digits, spaces nor punctuation
    ("most", 0.15, 0.3),  # share of the commonest word within windows
)
ABUSE = 3
LEAST_WORDS = 10
#: Good and bad documents that are assumed before any is seen.
EXPECTED = (9, 1)


def words_of(data: bytes) -> list[bytes]:
    return data.split()


def measures(words: list[bytes], data: bytes) -> tuple[float, ...]:
    n = len(words)
    tails = Counter(w[-1] for w in words)

    def word_byte(b: int) -> bool:
        return b >= 128 or 48 <= b <= 57 or b in LETTERS

    marked = sum(c for b, c in tails.items() if not word_byte(b) and b not in PLAIN_TAILS)
    letters = len(data) - len(data.translate(None, LETTERS))
    upper = len(data) - len(data.translate(None, UPPER))
    bare = sum(not (word_byte(w[0]) or word_byte(w[-1])) for w in words)
    distinct = most = 0
    for i in range(0, n, WINDOW):
        own = words[i : i + WINDOW]
        kinds = set(own)
        distinct += len(kinds)
        # only where words repeat much can one of them be common
        most += max(Counter(own).values()) if 2 * len(kinds) < len(own) else 1
    ended = sum(tails[b] for b in ENDS)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (
        marked / n, upper / max(1, letters), bare / n, distinct / n, tails[33] / n, 1 - ended / n,
        symbols / len(data), most / n,
    )


def form_votes(values: tuple[float, ...], n: int) -> list[int]:
    if n < LEAST_WORDS:
        return [ABSTAIN] * len(MEASURES)
    votes = []
    for value, (_, good, bad) in zip(values, MEASURES):
        if good > bad:
            value, good, bad = -value, -good, -bad
        votes.append(GOOD if value <= good else BAD if value >= bad else ABSTAIN)
    return votes


def bare_word(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()-#%&$*|")


def abuse_votes(present: set[bytes], lexicon: dict[bytes, int]) -> list[int]:
    """One vote per labeller that has words: bad if one of them occurs, good if not."""
    dealt = set(lexicon.values())
    votes = [GOOD if i in dealt else ABSTAIN for i in range(ABUSE)]
    for word in present & lexicon.keys():
        votes[lexicon[word]] = BAD
    return votes


def pattern(votes: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


def votes_in(number: int, n: int) -> list[int]:
    return [number // 3**i % 3 for i in range(n)]


N_VOTES = len(MEASURES) + ABUSE


@dataclass
class Seen:
    """What the labellers and the scorer see of a text."""

    votes: list[int]
    features: np.ndarray

    @classmethod
    def of(cls, data: bytes, lexicon: dict[bytes, int], hashed: bool = True) -> Seen | None:
        words = words_of(data)
        if not words:
            return None
        values = measures(words, data)
        present = {bare_word(w) for w in set(data.translate(LOWER).split())}
        votes = form_votes(values, len(words)) + abuse_votes(present, lexicon)
        return cls(votes, hashed_features(values, present) if hashed else np.zeros(0, np.int64))


def hashed_features(values: tuple[float, ...], present: set[bytes]) -> np.ndarray:
    levels = [b"\0%d:%d" % (i, round(v * 20)) for i, v in enumerate(values)]
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(w) % BUCKETS for w in (*levels, *present)], np.int64))


class LatentClass:
    """Two classes, each with its own chances of a labeller's answers where it gives one; that
    it abstains says nothing. ``fit`` is EM over vote patterns and their counts."""

    def __init__(self, labellers: int):
        self.prior = np.array(EXPECTED) / sum(EXPECTED)
        self.chance = np.ones((2, labellers, 3)) * [1, 0.5, 0.5]

    def fit(self, patterns: list[list[int]], counts: list[int], rounds: int = 200) -> LatentClass:
        votes, count = np.array(patterns, np.int64), np.array(counts, np.float64)
        if not len(votes):
            return self
        # bad votes are the rare ones: start from "some labeller calls it bad"
        bad = np.where((votes == BAD).any(1), 0.9, 0.05)
        for _ in range(rounds):
            share = np.stack((1 - bad, bad)) * count
            self.prior = (share.sum(1) + EXPECTED) / (count.sum() + sum(EXPECTED))
            given = np.stack([share @ (votes == a) for a in (GOOD, BAD)], axis=2) + 0.1
            self.chance[:, :, GOOD:] = given / given.sum(2, keepdims=True)
            new = self.posterior(votes)
            if np.abs(new - bad).max() < 1e-9:
                break
            bad = new
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of being bad for each row of votes."""
        each = np.arange(votes.shape[1])
        log = np.log(self.prior)[:, None] + np.log(self.chance[:, each, votes]).sum(2)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, the share of right answers among those it gives."""
        right = self.prior[0] * self.chance[0, :, GOOD] + self.prior[1] * self.chance[1, :, BAD]
        wrong = self.prior[0] * self.chance[0, :, BAD] + self.prior[1] * self.chance[1, :, GOOD]
        return right / (right + wrong)


@dataclass
class LabelModel:
    form: LatentClass
    abuse: LatentClass

    @classmethod
    def fit(cls, counts: dict[int, int]) -> LabelModel:
        votes = [votes_in(p, N_VOTES) for p in counts]
        k, n = len(MEASURES), list(counts.values())
        return cls(
            LatentClass(k).fit([v[:k] for v in votes], n),
            LatentClass(ABUSE).fit([v[k:] for v in votes], n),
        )

    def bad(self, votes: list[list[int]]) -> np.ndarray:
        """The chance that form or abuse make a text bad."""
        both = np.array(votes, np.int64).reshape(-1, N_VOTES)
        k = len(MEASURES)
        fine = (1 - self.form.posterior(both[:, :k])) * (1 - self.abuse.posterior(both[:, k:]))
        return 1 - fine


@dataclass
class Scorer:
    """A linear model over hashed features."""

    weights: np.ndarray
    bias: float

    def bad(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weights[features].sum() + self.bias))))


def train(
    rows: list[np.ndarray], bad: np.ndarray, rounds: int = 300, sparsity: float = 5e-5
) -> Scorer:
    """Logistic regression on soft labels by accelerated proximal gradients, with an L1 term
    that leaves words without bearing at zero."""
    if not rows:
        return Scorer(np.zeros(BUCKETS, np.float32), -5.0)
    # the bias is a feature of every row
    index = np.concatenate([np.append(r, BUCKETS) for r in rows])
    starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in rows])[:-1]))
    length = np.diff(np.append(starts, len(index)))
    n = len(rows)
    step = 4 * n / (length.max() * n)  # a bound of the curvature
    weights = ahead = np.zeros(BUCKETS + 1)
    speed, rate = 1.0, step * np.sqrt(length.max())
    floor = rate * sparsity

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.add.reduceat(w[index], starts)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        value = np.logaddexp(0, z) - bad * z
        return value.mean(), np.bincount(index, np.repeat((p - bad) / n, length), BUCKETS + 1)

    for _ in range(rounds):
        value, slope = loss(ahead)
        while True:  # halve the rate until the step is a descent
            new = ahead - rate * slope
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - floor, 0)
            move = new - ahead
            after = loss(new)[0]
            if after <= value + slope @ move + move @ move / (2 * rate) + 1e-12:
                break
            rate /= 2
            floor = rate * sparsity
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - weights)
        weights, speed = new, faster
    return Scorer(weights[:-1].astype(np.float32), float(weights[-1]))


def lexicon_of(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> dict[bytes, int]:
    """Words of the abuse labellers, from at most ``rows`` labelled documents."""
    known = labels.select(
        F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")
    ).dropna()
    known = known.orderBy(F.xxhash64("_id"), "_toxic").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_bytes().alias("_text"))
    chosen = texts.join(F.broadcast(known), "_id").dropDuplicates(["_text"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, toxic = [], []
            texts, labels = batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist()
            for data, label in zip(texts, labels):
                present = {bare_word(w) for w in data.translate(LOWER).split()} - {b""}
                own += [*present, b""]  # the empty word counts texts
                toxic += [label] * (len(present) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), pa.array(toxic, pa.int32())], names=["word", "toxic"]
            )

    counts = (
        chosen.select("_text", "_toxic")
        .mapInArrow(words, "word binary, toxic int")
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        .filter(F.col("t") >= TOXIC_LEAST)
    )
    counts = written(counts, "quality-words")
    total = counts.filter(F.octet_length("word") == 0).first()
    if total is None:
        return {}
    telling = counts.filter(
        (F.octet_length("word") > 0)
        & (F.col("t") >= TOXIC_SHARE * total["t"])
        & (F.col("t") >= TOXIC_PRECISION * F.col("n"))
    )
    # the commonest words go to different labellers
    words = sorted(((-r["t"], bytes(r["word"])) for r in telling.collect()))
    return {word: i % ABUSE for i, (_, word) in enumerate(words)}


@dataclass
class Classifier:
    lexicon: dict[bytes, int]
    model: LabelModel
    scorer: Scorer

    def judge(self, data: bytes) -> tuple[float, float]:
        """Chances of being bad: by the votes, and by the scorer."""
        seen = Seen.of(data, self.lexicon)
        if seen is None:
            return 1.0, 1.0
        return float(self.model.bad([seen.votes])[0]), self.scorer.bad(seen.features)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    training_rows: int = TRAINING_ROWS,
    labelled_rows: int = LABELLED_ROWS,
) -> Classifier:
    spark = docs.sparkSession
    small_batches(spark)
    lexicon = lexicon_of(docs, labels, labelled_rows)
    share = min(1.0, training_rows / max(1, docs.count()))
    draw = F.xxhash64(F.col("doc_id").cast("long")) / 2.0**64 + 0.5

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, features = [], []
            texts, drawn = batch.column("text").to_pylist(), batch.column("drawn").to_pylist()
            for data, chosen in zip(texts, drawn):
                seen = Seen.of(data, lexicon, hashed=chosen)
                numbers.append(pattern(seen.votes) if seen else None)
                features.append(seen.features if seen and chosen else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(features, pa.list_(pa.int64()))],
                names=["pattern", "features"],
            )

    seen = written(
        docs.select(text_bytes().alias("text"), (draw < share).alias("drawn")).mapInArrow(
            look, "pattern long, features array<long>"
        ),
        "quality-votes",
    )
    counts = seen.filter("pattern IS NOT NULL").groupBy("pattern").count().collect()
    model = LabelModel.fit({r["pattern"]: r["count"] for r in sorted(counts)})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, votes = [], []
        for batch in batches:
            rows += [v.values.to_numpy() for v in batch.column("features")]
            votes += [votes_in(p, N_VOTES) for p in batch.column("pattern").to_pylist()]
        scorer = train(rows, model.bad(votes))
        yield pa.RecordBatch.from_arrays(
            [pa.array([scorer.weights.tobytes()]), pa.array([scorer.bias])],
            names=["weights", "bias"],
        )

    # one task, of at most the bounded number of rows; in order, so that refits agree
    ready = seen.filter("features IS NOT NULL").repartition(1)
    ready = ready.sortWithinPartitions(F.xxhash64("features"), "pattern")
    fitted = ready.mapInArrow(learn, "weights binary, bias double").first()
    if fitted is None:  # no row, no task
        return Classifier(lexicon, model, train([], np.zeros(0)))
    scorer = Scorer(np.frombuffer(fitted["weights"], np.float32), fitted["bias"])
    return Classifier(lexicon, model, scorer)


JUDGED = T.StructType(
    [T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())]
)


def judged(docs: DataFrame, classifier: Classifier, column: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``posterior, score``: chances of being bad."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.arrow_udf(JUDGED)
    def judge(texts: pa.Array) -> pa.Array:
        own = shared.value
        values = [own.judge(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([v[i] for v in values], pa.float64()) for i in (0, 1)],
            names=["posterior", "score"],
        )

    return docs.withColumn(column, judge(text_bytes(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, posterior, score, kept`` for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = judged(own, fit(own, labels), "judged")
    return found.select(
        "doc_id",
        F.col("judged.posterior").alias("posterior"),
        F.col("judged.score").alias("score"),
        (F.col("judged.score") < 0.5).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    name = "_judged"
    while re.search(rf"(?i)\b{name}\b", " ".join(docs.columns)):
        name = "_" + name
    found = judged(docs, fit(docs, labels), name)
    return found.filter(F.col(name)["score"] < 0.5).drop(name)
