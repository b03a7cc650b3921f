"""Token counts with a digest cache.

The cache is a table of ``digest, length, n_tokens`` in a folder for each tokenizer version; a
version is the SHA-256 of the library, its release, the rules below and the tokenizer's file, so
counts of one never answer for another. A run

1. keys every text by the SHA-256 and length of its content, in the JVM,
2. finds the distinct keys that the cache lacks, from keys alone,
3. brings one text for each of these to a task: repeats leave inside each task first, then
   texts are dealt by key; where the missing keys are few enough to be broadcast, only their
   texts move at all,
4. encodes them once each and appends the counts to the cache in one commit,
5. joins the stored counts to all rows by key. Of a text that is a third of all rows, one copy
   per task is moved and one is encoded; Spark splits the hot key in the last join.

A run that dies leaves the cache as it was, one that is repeated finds what was appended. Two
runs at once may store a key twice; readers merge equal keys.

Counting: the library's own answer without added special tokens, truncation or padding; special
strings inside a text are what the library takes them for. A byte-level BPE file without a
normaliser allows a shorter way to the same number: text is split by the pre-tokenizer's pattern
and each distinct word goes to the library's model once, then to a worker's memo of bounded
size. It is taken for text without a character of ``UNSURE`` or a special string; any
other text goes to the library whole. Texts over ``PIECE`` characters are cut where a letter, a
space and a letter meet, since no token and no special string spans that place.

Defined results: a null text is empty and has no token. ``normal`` is applied before digest and
count; by default content is the text itself, as any change of case, blanks or Unicode form would
change a byte-level count. Repeated rows are counted one by one, ties cannot occur. A text without
a place to cut is encoded whole, whatever its length. An empty table gives an empty result and
appends nothing. Columns beside the two named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import sentencepiece
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterance_guard.llm.common import scratch, small_batches, written
from utterance_guard.operators.sizes import fits_broadcast

KEY = ["digest", "length"]
STORED = "digest binary, length long, n_tokens long"
LIMIT = 512
MODEL_BYTES = 64 << 20
PIECE = 1 << 18
MEMO_WORDS = 400_000
#: Anything but printable ASCII and old characters of European scripts, on whose classes all
#: Unicode releases agree.
UNSURE = regex.compile(r"[^\t\n\r\x20-\x7E¡-ӿ‐-‧€]")
# Fixed value: the split of byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEAM = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@dataclass(frozen=True)
class TokenizerFile:
    """A ``.json`` file of tokenizers or a ``.model`` file of sentencepiece, as bytes; its size
    bounds what is broadcast."""

    name: str
    data: bytes

    @classmethod
    def read(cls, path: str) -> TokenizerFile:
        if os.path.getsize(path) > MODEL_BYTES:
            raise ValueError(f"{path} is too large to be sent to every worker")
        with open(path, "rb") as file:
            return cls(os.path.basename(path), file.read())

    @property
    def version(self) -> str:
        library = sentencepiece if self.name.endswith(".model") else tokenizers
        rules = f"{library.__name__} {library.__version__} no added tokens, whole texts\n"
        return hashlib.sha256(rules.encode() + self.data).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        if self.name.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        return JsonCounter(self.data)


class JsonCounter:
    """Counts by a tokenizers file."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        self.library = tokenizers.Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.short = self._plain_bytes(added)
        self.words = regex.compile(WORDS)
        self.memo: dict[str, int] = {}
        # a byte's own character where that can be printed, else the next free one from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        free = [b for b in range(256) if b not in own]
        self.spelling = {b: b for b in own} | {b: 256 + i for i, b in enumerate(free)}

    def _plain_bytes(self, added: list[str]) -> bool:
        """Whether words can be counted one by one: byte-level, nothing before and after."""
        split = self.library.pre_tokenizer
        return (
            isinstance(self.library.model, tokenizers.models.BPE)
            and isinstance(split, tokenizers.pre_tokenizers.ByteLevel)
            and not split.add_prefix_space
            and split.use_regex
            and self.library.normalizer is None
            and self.library.post_processor is None
            and not any(" " in token for token in added)
        )

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.short:
            return [len(self._encode([t])[0]) for t in texts]
        return [sum(map(self._count, pieces(t))) for t in texts]

    def _encode(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def _count(self, text: str) -> int:
        if UNSURE.search(text) or (self.special and self.special.search(text)):
            return len(self._encode([text])[0])
        words, memo = self.words.findall(text), self.memo
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
        model = self.library.model
        for word in words:
            if word not in memo:
                letters = word.encode().decode("latin-1").translate(self.spelling)
                memo[word] = len(model.tokenize(letters))
        return sum(map(memo.__getitem__, words))


def pieces(text: str) -> Iterator[str]:
    """A long text in parts that are encoded as they would be within it."""
    at = 0
    while len(text) - at > PIECE:
        seam = SEAM.search(text, at + PIECE)
        if seam is None:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:] if at else text


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """What a version's folder holds, one row a key. A folder that is not there holds nothing."""
    try:
        rows = spark.read.schema(STORED).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)
    return rows.groupBy(*KEY).agg(F.min("n_tokens").alias("n_tokens"))


def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key among those of a task, which remembers digests only."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, digest in enumerate(batch.column("digest").to_pylist()):
            if digest not in seen:
                seen.add(digest)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


def encoder(model):
    """Counts for rows in order of key, in which a row without content says that the key is
    missing; the first content after it is encoded."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, asked = None, None
        for batch in batches:
            rows, texts = [], []
            content = batch.column("content")
            keys = zip(batch.column("digest").to_pylist(), batch.column("length").to_pylist())
            for i, key in enumerate(keys):
                if not content[i].is_valid:
                    asked = key
                elif key == asked:
                    asked = None
                    rows.append(i)
                    texts.append(content[i].as_py())
            if not rows:
                continue
            count = count or model.value.counter()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(rows, pa.int64())) for c in KEY],
                    pa.array(count(texts), pa.int64()),
                ],
                names=[*KEY, "n_tokens"],
            )

    return encode


def count_tokens(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    cache: str,
    limit: int = LIMIT,
    normal: Callable[[Column], Column] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row. ``cache`` is a folder that all
    executors reach; counts that it lacks are added to it. With ``normal``, name a cache of its
    own for that form."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{cache.rstrip('/')}/{tokenizer.version}"
    whole = F.coalesce(F.col(text), F.lit(""))
    content = normal(whole) if normal else whole
    key = [
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
        F.octet_length(content).cast("long").alias("length"),
    ]
    keyed = written(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.octet_length(whole).cast("long").alias("n_bytes"),
            *key,
        ),
        "token-keys",
    )
    known = stored(spark, folder)
    missing = written(
        keyed.select(*KEY).distinct().join(known, KEY, "left_anti"), "missing-tokens"
    )
    if not missing.isEmpty():
        texts = docs.select(*key, content.alias("content"))
        if fits_broadcast(missing):
            texts = texts.join(F.broadcast(missing), KEY, "left_semi")
        copies = texts.mapInArrow(first_copies, "digest binary, length long, content string")
        asked = missing.select(*KEY, F.lit(None).cast("string").alias("content"))
        # texts are narrowed to one a task before they are dealt, and never dealt twice
        dealt = copies.unionByName(asked).withColumn("answers", F.col("content").isNotNull())
        dealt = dealt.repartition(parts, *KEY).sortWithinPartitions(*KEY, "answers")
        model = spark.sparkContext.broadcast(tokenizer)
        counted = dealt.drop("answers").mapInArrow(encoder(model), STORED)
        counted.write.mode("append").parquet(folder)
    counts = written(stored(spark, folder), "token-counts")
    return keyed.join(counts, KEY).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def fresh_cache(spark: SparkSession) -> str:
    return scratch(spark, "token-cache")
