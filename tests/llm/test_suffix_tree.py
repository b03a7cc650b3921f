from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from utterance_guard.llm import suffix_tree
from utterance_guard.llm.suffix_tree import (
    DIVERGENCE, SMOOTHING, TEST, Words, fit, followed, least, score_texts,
)

SCHEMA = "doc_id long, text string, score string, word int"


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), b""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Brute:
    """Counts, tree and scores by the definition, over all contexts as tuples, oldest first."""

    def __init__(self, rows):
        texts = [tokens(text) for i, text in rows if not held(i)]
        self.counts = Counter(t for text in texts for t in text)
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        self.named = {t for t, c in self.counts.items() if t and c >= least(self.n)}
        other = [t for t in self.counts if t and t not in self.named]
        self.other = sum(self.counts[t] for t in other), len(other)
        coded = [["<start>", *map(self.symbol, text)] for text in texts]
        self.root = Counter(s for text in coded for s in text[1:])
        self.states, level = {}, [()]
        while level:
            after = {}
            for text in coded:
                for i in range(1, len(text)):
                    own = self.longest(text[:i])
                    k = len(own) + 1
                    if own in level and k <= i:
                        after.setdefault(tuple(text[i - k : i]), Counter())[text[i]] += 1
            level = []
            for context, seen in after.items():
                total = sum(seen.values())
                if total >= least(self.n) and self.differs(context, seen, total):
                    level.append(context)
            for context in level:
                kept = {s: c for s, c in after[context].items() if c >= followed(self.n)}
                self.states[context] = (sum(after[context].values()), kept)

    def symbol(self, token):
        return token if token in self.named else "<end>" if token == b"" else "<other>"

    def longest(self, before):
        k = 0
        while k < len(before) and tuple(before[len(before) - k - 1 :]) in self.states:
            k += 1
        return tuple(before[len(before) - k :])

    def chance(self, context, symbol):
        if not context:
            return (self.root[symbol] + 1) / (sum(self.root.values()) + len(self.named) + 2)
        total, kept = self.states[context]
        left = (total - sum(kept.values()) + SMOOTHING) / (total + SMOOTHING)
        return kept.get(symbol, 0) / (total + SMOOTHING) + left * self.chance(context[1:], symbol)

    def differs(self, context, seen, total):
        kept = {s: c for s, c in seen.items() if c >= followed(self.n)}
        plain = lambda total, kept: {s: c / total for s, c in kept.items()}
        root = {s: self.chance((), s) for s in kept}
        chance = plain(*self.states[context[1:]]) if context[1:] else root
        chance = {s: chance[s] for s in kept}
        gain = sum(c * math.log(c / (total * chance[s])) for s, c in kept.items())
        if rest := total - sum(kept.values()):
            gain += rest * math.log(rest / max(total - total * sum(chance.values()), 1e-9))
        freedom = max(len(kept), 1)
        c = 2 / (9 * freedom)
        deviate = (max(2 * gain / freedom, 0) ** (1 / 3) - (1 - c)) / math.sqrt(c)
        return deviate > TEST and gain >= DIVERGENCE * total

    def judged(self, text):
        own, before, score = tokens(text), ["<start>"], 0.0
        for t in own:
            score += math.log10(self.chance(self.longest(before), self.symbol(t)))
            before.append(self.symbol(t))
            if before[-1] == "<other>":
                count, kinds = self.other
                score += math.log10((self.counts[t] + 0.1) / (count + 0.1 * (kinds + 1)))
        mass = self.n + 0.1 * (self.v + 1)
        base = sum(math.log10((self.counts[t] + 0.1) / mass) for t in own)
        return len(own), sum(self.counts[t] > 0 for t in own), self.n, base, score


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    model = fit(docs)
    found = score_texts(docs, model).collect()
    brute = Brute(rows)
    assert len(model.tree.suffix) == len(brute.states) + 1
    whole = lambda values: (str(values[0]), *values[1:4], *(round(v, 6) for v in values[4:]))
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    wanted = sorted(whole((i, *brute.judged(text))) for i, text in rows)
    for got, want in zip(sorted(whole([r[c] for c in names]) for r in found), wanted, strict=True):
        assert got[:4] == want[:4] and got[4:] == pytest.approx(want[4:], rel=1e-7)
    assert all(r["held_out"] == held(r["doc_id"]) and r["score"] < 0 for r in found)
    return model, found


def prose(rng, n):
    """Common words whose next word depends on the last one, and rare words."""
    common, out = [f"c{i}" for i in range(40)], [0]
    for _ in range(n):
        out.append((out[-1] * 7 + 3) % 40 if rng.random() < 0.5 else rng.randrange(40))
    return " ".join(common[i] if rng.random() < 0.8 else f"r{rng.randrange(5000)}" for i in out)


def test_scores(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(10, 90))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "C1 c2"), (None, "c3"), (7, "again é\x85x"), (7, " \t")]
    rows += [(2000, "c1 c2 " * 8000), (3000, "unheard of words")]
    rows += [(7, "again é\x85x"), (None, "c3"), (2000, "c5")]  # a row for each
    model, found = check(spark, rows)
    assert (model.tree.depth == 1).sum() >= 20
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 100


def test_without_common_words(spark):
    rows = [(i, f"w{i} w{i + 1} the") for i in range(60)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])
    only = next(i for i in range(100) if held(i))
    _, found = check(spark, [(only, "nothing is known")])
    assert found[0]["n_known"] == 0


def test_depth_is_set_by_the_test(spark):
    """What follows the fifth word before, and no word between, makes states of five symbols."""
    rng, rows = random.Random(5), []
    for i in range(300):
        head = rng.choice("ab")
        rows.append((i, " ".join(f"{head} x x x x {head.upper()}1" for _ in range(6))))
    model, _ = check(spark, rows)
    assert model.tree.depth.max() >= 5


def test_states_grow_with_the_corpus(spark):
    def states(n):
        rng, rows = random.Random(3), []
        for i in range(n):
            at = [min(int(rng.paretovariate(0.9)), 3000) for _ in range(60)]
            rows.append((i, " ".join(f"w{a} v{a}" for a in at)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return len(fit(docs).tree.suffix)

    few, more, most = states(100), states(400), states(1600)
    assert few * 1.3 < more and more * 1.3 < most


def test_many_copies_of_a_row_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "COPIES", 3)
    rows = spark.createDataFrame([(1, 7), (2, 3), (3, 1)], "doc_id long, copies long")
    got = Counter(r["doc_id"] for r in suffix_tree.copied(rows).collect())
    assert got == {1: 7, 2: 3, 3: 1}


def test_chances_after_a_state_sum_to_one(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(200)], "doc_id long, text string")
    model = fit(docs)
    for node in range(len(model.tree.suffix)):
        p = 10 ** model.tree.chance(np.full(model.words.symbols, node), np.arange(model.words.symbols))
        assert p.sum() == pytest.approx(1)


def test_other_words_share_their_symbol():
    common = [(b"the", 50), (b"of", 20), (b"by", 2), (b"", 10)]
    words = Words.of(100, 30, common)
    assert words.symbols == 4 and 2 < least(100) < 20
    assert words.symbols_of(words.ranks([b"of", b"x", b"by", b"the"])).tolist() == [4, 3, 0, 0, 2, 1]
    assert words.other_tokens == 20 and words.other_kinds == 27


def test_rows_of_texts_do_not_share_a_key_of_the_join(spark):
    row = lambda i, word, times: (i, 5, False, word, times, 3, 1, -1.0, -1.0)
    parts = [row(i, b"", 0) for i in range(50)] + [row(i, b"rare", 2) for i in range(3)]
    keyed = suffix_tree.scored_keys(spark.createDataFrame(parts, suffix_tree.SCORED)).collect()
    ends = {bytes(r["word"]) for r in keyed if not r["times"]}
    assert len(ends) == 50 and all(k.startswith(b" ") for k in ends)
    assert [bytes(r["word"]) for r in keyed if r["times"]] == [b"rare"] * 3


def test_the_sieve_finds_what_a_search_finds():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5000):
        table = np.unique(rng.integers(0, 9000, size) << 32 | rng.integers(0, 6000, size))
        keys = rng.permutation(np.concatenate((rng.integers(0, 9000, 20_000) << 32, table, table)))
        at = suffix_tree.find(table, keys)
        which, places = suffix_tree.Sieve(table).find(keys)
        assert which.tolist() == np.flatnonzero(at >= 0).tolist()
        assert places.tolist() == at[at >= 0].tolist()
