"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the words seen often enough, the end of a text, and one symbol for all other words.
The tree grows level by level from the empty context. Every state of the last level is extended by
the symbol before it; an extension becomes a state if it is seen often enough to be judged, a
likelihood-ratio test finds that the symbols after it are spread differently than after the state
it extends, and the two shares diverge by ``DIVERGENCE`` at least. Growth ends where no extension
passes, so the test alone sets the depth. What follows a state is its own counts, smoothed by the
distribution of its suffix. A symbol is scored in the longest state that the text before it ends
with. A word behind the symbol for all others is given by its own count among them, smoothed by a
tenth of an occurrence, with as much left for words never seen.

"Often enough" is ``least`` = 8 + sqrt(N) / 16 occurrences in N training tokens, at every size.
So symbols, and states of a level, grow with the corpus, but there are at most N / least, under
16 sqrt(N), of each (of following symbols kept with a state: eight times as many): a table that
every task can have, while the corpus itself is never gathered. Counts of words and of extensions
are Spark tables. Words of at least ``COMMON`` of all tokens, of which there are a million at most,
are looked up by every task as well; all other words by a join, in which none makes up more than
``COMMON`` of all tokens.

Defined results: a null text is an empty one, which is one end; a text may be as long as a row can
be. There is one row for each row, also for those that share a doc_id, or text, or have no
doc_id, which counts as the empty text for the split. (Rows are told apart by doc_id and a 64-bit
hash of the text; equal ones have equal results.) Without training rows no token is known. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import LOWER, arrow_bytes, small_batches, text_bytes, written

FOLDS = 10
ADD = 0.1
COMMON = 1e-6
#: Normal deviate of the likelihood-ratio test, about one in ten thousand.
TEST = 3.72
#: Least divergence of a state from its suffix, in nats a symbol.
DIVERGENCE = 0.01
SMOOTHING = 20.0
OTHER = 0
END = b""
FLUSH = 1 << 20
#: Copies of a row that are written out at a time.
COPIES = 1 << 16


def least(tokens: int) -> float:
    """Occurrences from which a word is a symbol and a context can be a state."""
    return 8 + math.sqrt(tokens) / 16


def followed(tokens: int) -> float:
    """Occurrences from which a symbol after a state is kept with it."""
    return least(tokens) / 8


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, the empty word for the ends, in parts of bounded size."""

    def part(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    counts: Counter = Counter()
    for batch in batches:
        for data in batch.column("text").to_pylist():
            counts.update(data.translate(LOWER).split())
            counts[END] += 1
        if len(counts) > FLUSH:
            yield part(counts)
            counts.clear()
    if counts:
        yield part(counts)


@dataclass
class Words:
    """What every task knows of words: the common ones."""

    tokens: int
    kinds: int
    rank: dict[bytes, int] = field(default_factory=dict)
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Symbol by rank, and the logarithm of the word's share of its symbol.
    symbol: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    within: np.ndarray = field(default_factory=lambda: np.zeros(0))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    end: int = 1
    symbols: int = 2
    end_count: int = 0
    other_tokens: int = 0
    other_kinds: int = 0

    @classmethod
    def of(cls, tokens: int, kinds: int, common: list[tuple[bytes, int]]) -> Words:
        """``common``: words with their counts, the end among them if there was any."""
        common = sorted(common, key=lambda wc: (-wc[1], wc[0]))
        ends = dict(common).get(END, 0)
        common = [wc for wc in common if wc[0] != END]
        own = cls(tokens, kinds, end_count=ends)
        own.rank = {w: i for i, (w, _) in enumerate(common)}
        own.count = count = np.array([c for _, c in common], np.float64)
        named = count >= least(tokens)
        own.symbol = np.where(named, np.arange(len(count)) + 2, OTHER)
        own.symbols = 2 + int(named.sum())
        own.other_tokens = tokens - ends - int(count[named].sum())
        own.other_kinds = kinds - (ends > 0) - int(named.sum())
        own.base = np.log10((count + ADD) / own.all_mass)
        own.within = np.where(named, 0.0, np.log10((count + ADD) / own.other_mass))
        return own

    @property
    def all_mass(self) -> float:
        return self.tokens + ADD * (self.kinds + 1)

    @property
    def other_mass(self) -> float:
        return self.other_tokens + ADD * (self.other_kinds + 1)

    @property
    def start(self) -> int:
        return self.symbols  # stands before a text

    def ranks(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))

    def symbols_of(self, ranks: np.ndarray) -> np.ndarray:
        """The start, the symbols of a text's words, and its end."""
        out = np.empty(len(ranks) + 2, np.int64)
        out[0], out[-1] = self.start, self.end
        out[1:-1] = np.where(ranks >= 0, self.symbol[ranks], OTHER) if len(self.symbol) else OTHER
        return out


def encoder(shared):
    """Texts as symbols, four bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        symbols = zip(words.rank, words.symbol.tolist())
        named = {w: s for w, s in symbols if s != OTHER}

        def code(text: bytes) -> bytes:
            own = text.translate(LOWER).split()
            out = np.empty(len(own) + 2, "<i4")
            out[0], out[-1] = words.start, words.end
            out[1:-1] = np.fromiter(map(named.get, own, repeat(OTHER)), np.int32, len(own))
            return out.tobytes()

        for batch in batches:
            coded = [code(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(coded, pa.binary())], names=["symbols"])

    return encode


def blocks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts texts, given by where each ends after the first's begin, into blocks of at most
    ``FLUSH`` symbols, or one longer text."""
    first = 0
    while first < len(ends) - 1:
        last = int(np.searchsorted(ends, ends[first] + FLUSH, "right")) - 1
        last = max(last, first + 1)
        yield int(ends[first]), int(ends[last])
        first = last


def extension_counter(shared_tree, level: int):
    """How often each extension of a state of the level before occurs, under the symbol
    ``WHOLE``, and how often each symbol follows it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, n = shared_tree.value.towards(level - 1), [], 0
        often = Sieve(tree.often)

        def part() -> pa.RecordBatch:
            context, symbol = (np.concatenate(x) for x in zip(*held))
            own, context = pd.factorize(context)
            total = np.bincount(own)
            pair, times = np.unique(own << 32 | symbol, return_counts=True)
            symbol = np.concatenate((pair & LOW, np.full(len(context), WHOLE)))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((context[pair >> 32], context))),
                    pa.array(symbol.astype(np.int32)),
                    pa.array(np.concatenate((times, total)).astype(np.int64)),
                ],
                names=["context", "symbol", "n"],
            )

        for batch in batches:
            raw, ends = arrow_bytes(batch.column("symbols"))
            for begin, end in blocks(ends // 4):
                flat = raw[4 * begin : 4 * end].view("<i4").astype(np.int64)
                node, before = tree.longest(flat)
                at = np.flatnonzero((tree.depth[node] == level - 1) & (before >= 0))
                if level > 1:  # an extension occurs no more often than its first two symbols
                    oldest = flat[before[at]] << 32 | flat[before[at] + 1]
                    at = at[often.find(oldest)[0]]
                held.append((node[at] << 32 | flat[before[at]], flat[at]))
                n += len(at)
                if n > 4 * FLUSH:
                    yield part()
                    held, n = [], 0
        if n:
            yield part()

    return count


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Sieve:
    """Looks keys up in a sorted table, most of which it does not have: those are told by a
    slot of a few bits of their hash, at a fraction of a search."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.shift = np.uint64(64 - max(16, (16 * len(table)).bit_length()))
        self.taken = np.zeros(1 << int(64 - self.shift), bool)
        self.taken[self.slots(table)] = True

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = np.ascontiguousarray(keys).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are in the table, and their places there."""
        maybe = np.flatnonzero(self.taken[self.slots(keys)])
        at = find(self.table, keys[maybe])
        return maybe[at >= 0], at[at >= 0]


LOW = np.int64((1 << 32) - 1)
WHOLE = -1


@dataclass
class Tree:
    """States by number, the empty context first, and what follows them."""

    root: np.ndarray  # log10 chances of symbols
    start: int
    #: By state: the state without its oldest symbol, its length, log10 of what is left to the former.
    suffix: np.ndarray
    depth: np.ndarray
    left: np.ndarray
    #: State and the symbol before it, sorted; the state they make.
    edges: np.ndarray
    child: np.ndarray
    #: State and following symbol, sorted; log10 of the chance, smoothing included; plain share.
    follows: np.ndarray
    chances: np.ndarray
    shares: np.ndarray
    #: Pairs of neighbours seen often enough to be judged, sorted.
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def empty(cls, seen: np.ndarray) -> Tree:
        """The tree without contexts, from the counts of the symbols."""
        root = np.log10((seen + 1) / (seen.sum() + len(seen)))
        none, zero = np.zeros(0, np.int64), np.zeros(1, np.int64)
        return cls(root, len(seen), zero, zero, np.zeros(1), none, none, none, *np.zeros((2, 0)))

    def longest(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol of texts that each begin with the start: the longest state before it,
        and the place before that state, -1 where the text has none."""
        node = np.zeros(len(flat), np.int64)
        before = np.arange(len(flat)) - 1
        begins = flat == self.start
        to = self.first[flat[before]]
        to[begins], before[begins] = 0, -1
        go = np.flatnonzero(to)
        to = to[go]
        while go.size:
            node[go] = to
            whole = flat[before[go]] == self.start
            before[go] = np.where(whole, -1, before[go] - 1)
            go = go[~whole]
            there, at = self.sieve.find(node[go] << 32 | flat[before[go]])
            go, to = go[there], self.child[at]
        return node, before

    def towards(self, depth: int) -> Tree:
        """With only the edges on the way to states of that depth, which is the greatest."""
        bears = self.depth == depth
        for d in range(depth, 0, -1):
            bears[self.suffix[bears & (self.depth == d)]] = True
        kept = bears[self.child]
        return replace(self, edges=self.edges[kept], child=self.child[kept])

    @cached_property
    def sieve(self) -> Sieve:
        return Sieve(self.edges)

    @cached_property
    def first(self) -> np.ndarray:
        """By symbol, the start last: its state of one symbol, 0 for none."""
        states = np.zeros(self.start + 1, np.int64)
        one = self.edges >> 32 == 0
        states[self.edges[one]] = self.child[one]
        return states

    def chance(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the symbols' chances in states."""
        out, todo, node = np.zeros(len(node)), np.arange(len(node)), node.copy()
        while todo.size:
            here = node[todo]
            there = find(self.follows, here << 32 | symbol[todo])
            kept = (there >= 0) & (here > 0)
            out[todo[kept]] += self.chances[there[kept]]
            out[todo[here == 0]] += self.root[symbol[todo[here == 0]]]
            todo = todo[~kept & (here > 0)]
            out[todo] += self.left[node[todo]]
            node[todo] = self.suffix[node[todo]]
        return out

    def extended(self, contexts, totals, pairs) -> Tree:
        """With those extensions as states that pass the test. ``contexts``: sorted, state and
        symbol before it; ``totals``: how often each occurs; ``pairs``: contexts, following
        symbols and counts, of those kept."""
        context, symbol, n = pairs
        own = find(contexts, context)
        symbol, n, own = symbol[own >= 0], n[own >= 0], own[own >= 0]
        shorter = 10 ** self.chance(contexts[own] >> 32, symbol)
        # what follows an extension often enough follows the state that it extends so, too
        expected = totals[own] * (10 ** self.root[symbol])
        deep = contexts[own] >> 32 > 0
        at = find(self.follows, contexts[own][deep] >> 32 << 32 | symbol[deep])
        expected[deep] = totals[own][deep] * self.shares[at]
        size = len(contexts)
        gain = np.bincount(own, n * np.log(n / expected), size).astype(np.float64)
        rest = totals - np.bincount(own, n, size)
        left = np.maximum(totals - np.bincount(own, expected, size), 1e-9)
        gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-9) / left), 0)
        freedom = np.maximum(np.bincount(own, minlength=size), 1)
        c = 2 / (9 * freedom)
        deviate = (np.maximum(2 * gain / freedom, 0) ** (1 / 3) - (1 - c)) / np.sqrt(c)
        passed = (deviate > TEST) & (gain >= DIVERGENCE * totals)

        whole = totals + SMOOTHING
        left = (rest + SMOOTHING) / whole
        number = np.cumsum(passed) - 1 + len(self.suffix)
        mine = passed[own]
        chance = n[mine] / whole[own[mine]] + left[own[mine]] * shorter[mine]
        edges = np.concatenate((self.edges, contexts[passed]))
        child = np.concatenate((self.child, number[passed]))
        follows = np.concatenate((self.follows, number[own[mine]] << 32 | symbol[mine]))
        chances = np.concatenate((self.chances, np.log10(chance)))
        shares = np.concatenate((self.shares, (n / totals[own])[mine]))
        by_edge, by_follow = np.argsort(edges), np.argsort(follows)
        parent = contexts[passed] >> 32
        return Tree(
            self.root,
            self.start,
            np.concatenate((self.suffix, parent)),
            np.concatenate((self.depth, self.depth[parent] + 1)),
            np.concatenate((self.left, np.log10(left[passed]))),
            edges[by_edge],
            child[by_edge],
            follows[by_follow],
            chances[by_follow],
            shares[by_follow],
            self.often,
        )


SCORED = (
    "doc_id long, text_key long, held_out boolean, word binary, times long, "
    "n_tokens long, n_known long, base double, score double"
)


def scorer(shared_words, shared_tree):
    """For each text a row with what common words and the tree say, and a row for every other
    word."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tree = shared_words.value, shared_tree.value
        end = math.log10((words.end_count + ADD) / words.all_mass)
        for batch in batches:
            # per text: its row, then rows of rare words
            owner, rare, times, base, known, within, size, coded = ([] for _ in range(8))
            for i, data in enumerate(batch.column("text").to_pylist()):
                own = data.translate(LOWER).split()
                ranks = words.ranks(own)
                common = ranks[ranks >= 0]
                base.append(float(words.base[common].sum()) + end)
                within.append(float(words.within[common].sum()))
                known.append(len(common) + (words.end_count > 0))
                size.append(len(own) + 1)
                coded.append(words.symbols_of(ranks))
                other = Counter(own[j] for j in np.flatnonzero(ranks < 0).tolist())
                owner += [i] * (len(other) + 1)
                rare += [END, *other]
                times += [0, *other.values()]
            if not size:
                continue
            flat = np.concatenate(coded)
            inside = flat != words.start
            node = tree.longest(flat)[0][inside]
            back, pair = pd.factorize(node << 32 | flat[inside])
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            chance = tree.chance(pair >> 32, pair & LOW)[back]
            total = np.add.reduceat(chance, begin) + np.array(within)
            owner, first = np.array(owner), np.array(times) == 0
            fill = lambda values: np.where(first, np.array(values)[owner], 0)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("text_key").take(take),
                    batch.column("held_out").take(take),
                    pa.array(rare, pa.binary()),
                    pa.array(times, pa.int64()),
                    pa.array(fill(size), pa.int64()),
                    pa.array(fill(known), pa.int64()),
                    pa.array(fill(base), pa.float64()),
                    pa.array(fill(total), pa.float64()),
                ],
                names=[c.split()[0] for c in SCORED.split(", ")],
            )

    return score


@dataclass
class Model:
    words: Words
    tree: Tree
    counts: DataFrame  # word, n


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from the documents that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    training = docs.filter(~held_out(doc_id)).select(text_bytes(text).alias("text"))
    counts = written(
        training.mapInArrow(count_words, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "lm-words",
    )
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counts.filter(~is_rare(size[0])).toArrow()
    common = list(zip(common["word"].to_pylist(), common["n"].to_pylist()))
    words = Words.of(size[0], size[1], common)
    return Model(words, grow(training, words), counts)


def is_rare(tokens: int) -> Column:
    """Words of ``counts`` that are joined."""
    return (F.col("n") < min(COMMON * tokens, least(tokens))) & (F.octet_length("word") > 0)


def grow(training: DataFrame, words: Words) -> Tree:
    """The tree of the texts, a pass over their symbols for each level."""
    context = training.sparkSession.sparkContext
    coded = written(
        training.mapInArrow(encoder(context.broadcast(words)), "symbols binary"), "lm-symbols"
    )
    seen = np.zeros(words.symbols)
    seen[words.end] = words.end_count
    seen[OTHER] = words.other_tokens
    seen[words.symbol[words.symbol != OTHER]] = words.count[words.symbol != OTHER]
    tree, level, states = Tree.empty(seen), 1, 0
    while len(tree.suffix) > states:
        states = len(tree.suffix)
        enough = F.when(F.col("symbol") == WHOLE, least(words.tokens)).otherwise(
            followed(words.tokens)
        )
        counts = (
            coded.mapInArrow(
                extension_counter(context.broadcast(tree), level),
                "context long, symbol int, n long",
            )
            .groupBy("context", "symbol")
            .agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= enough)
            .toArrow()
        )
        state, symbol, n = (counts[c].to_numpy().astype(np.int64) for c in counts.column_names)
        order = np.lexsort((symbol, state))
        state, symbol, n = state[order], symbol[order], n[order].astype(np.float64)
        whole = symbol == WHOLE
        pairs = (state[~whole], symbol[~whole], n[~whole])
        if level == 1:
            neighbours = pairs[2] >= least(words.tokens)
            tree.often = pairs[0][neighbours] << 32 | pairs[1][neighbours]
        tree = tree.extended(state[whole], n[whole], pairs)
        level += 1
    return tree


def scored_keys(parts: DataFrame) -> DataFrame:
    """The row of each text itself matches no word; a key of its own, with a blank that no word
    has, spreads these rows over the join's partitions."""
    own = F.concat(F.lit(" "), F.xxhash64("doc_id", "text_key")).cast("binary")
    return parts.withColumn("word", F.when(F.col("times") > 0, F.col("word")).otherwise(own))


def score_texts(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text"):
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    context, words = docs.sparkSession.sparkContext, model.words
    parts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        F.xxhash64(text_bytes(text)).alias("text_key"),
        text_bytes(text).alias("text"),
    ).mapInArrow(scorer(context.broadcast(words), context.broadcast(model.tree)), SCORED)
    rare = model.counts.filter(is_rare(words.tokens)).select("word", F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    is_word = F.col("times") > 0

    def share(mass: float) -> Column:
        return F.when(is_word, F.col("times") * F.log10((c + F.lit(ADD)) / F.lit(mass)))

    joined = scored_keys(parts).join(rare.hint("merge"), "word", "left").select(
        "doc_id",
        "text_key",
        "held_out",
        (~is_word).cast("long").alias("copies"),
        "n_tokens",
        F.when(is_word, F.when(c > 0, F.col("times")).otherwise(0))
        .otherwise(F.col("n_known"))
        .alias("n_known"),
        F.coalesce(share(words.all_mass), "base").alias("base"),
        F.coalesce(share(words.other_mass), "score").alias("score"),
    )
    each = joined.groupBy("doc_id", "text_key").agg(
        F.bool_or("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "score")],
    )
    return copied(each).select(
        "doc_id",
        "held_out",
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )


def copied(rows: DataFrame) -> DataFrame:
    """Each row as many times as ``copies`` says, in blocks of bounded size."""
    last = F.expr(f"(copies - 1) div {COPIES}")
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    size = F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES).cast("int")
    return blocks.withColumn("copy", F.explode(F.array_repeat(F.lit(0), size)))
