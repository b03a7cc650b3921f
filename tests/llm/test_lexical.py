from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterance_guard.llm import lexical
from utterance_guard.llm.lexical import Heap, Postings, Shard, best_in_shard, build_index
from utterance_guard.llm.lexical import pack, search, terms_of, unpack

DOCS = "doc_id long, text string, term int, shard string, n int, head string"
ITEMS = "item_id long, text string, score int"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, bag in asked.items():
        found = []
        for i, own in bags:
            m = 25 + 75 * own.total() * len(bags) // total
            score = 0
            for t, times in bag.items():
                if own[t]:
                    w = math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * own[t] // (1000 * own[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [
            (item, rank + 1, None if none else i, -s)
            for rank, (s, none, i) in enumerate(sorted(found)[:k])
        ]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, **how):
    made = spark.createDataFrame([(i, t, 1, "s", 2, "h") for i, t in docs], DOCS).repartition(3)
    index = build_index(made, **how)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    return sorted(map(tuple, search(index, asked, k).collect()), key=str)


def corpus(seed, n=400, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(6000)]
    text = lambda m: " ".join(rng.choices(words, k=m))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(n)]
    docs += [(n + i, docs[rng.randrange(n)][1]) for i in range(60)]  # ties
    return docs, [(i, text(rng.randrange(1, 12))) for i in range(25)]


@pytest.mark.parametrize("shards", [{}, {"shard_docs": 17, "block": 4}, {"shard_tokens": 300}])
def test_corpus(spark, shards):
    docs, items = corpus(3)
    assert run(spark, docs, items, **shards) == brute(docs, items)


def test_nulls_ties_repeats_empty_and_long(spark):
    long = "Straße ÄRGER " * 60_000 + "rare"
    docs = [(5, "Same words"), (3, "same WORDS"), (4, "same-words"), (None, "same words")]
    docs += [(7, None), (8, ""), (9, "?!"), (10, long), (11, "rare"), (11, "rare"), (12, "ärger")]
    docs += [(20 + i, "same words") for i in range(20)] + [(50 + i, f"other{i}") for i in range(90)]
    items = [(1, "same words"), (2, "RARE"), (3, None), (4, ""), (5, "nowhere"), (6, "Ärger ÄRGER")]
    items += [(2, "RARE"), (2, "words"), (None, "same"), (7, "same " * 3000)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=2, shard_docs=2, block=1) == brute(docs, items, 2)


def test_hot_term_and_hot_text(spark):
    docs = [(i, "the common line" if i % 3 else f"the common line x{i}") for i in range(900)]
    items = [(1, "the common line"), (2, "x3 x6 the"), (3, "common x0")]
    assert run(spark, docs, items, shard_docs=100, block=8) == brute(docs, items)


def test_queries_in_blocks(spark, monkeypatch):
    docs, items = corpus(5, n=120)
    made = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = search(build_index(made), asked, block_bytes=200)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)
    assert len(list(lexical.query_blocks(asked, "item_id", "text", 200))) > 3


def test_empty_tables(spark):
    assert run(spark, [], [(1, "x")]) == []
    assert run(spark, [(1, "x")], []) == []
    assert run(spark, [(1, None)], [(1, "x")]) == []


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60))
def test_terms(data):
    text = data.decode("utf-8", "ignore")
    assert [t.decode() for t in terms_of(text.encode())] == terms(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=50))
def test_packing(values):
    data, ends = pack(np.array(values, np.int64))
    assert unpack(data).tolist() == values if values else len(data) == 0
    assert len(ends) == len(values)


def lists_of(docs, asked, block):
    shard = Shard()
    for i, text in docs:
        shard.add(i, terms_of(text.encode()))
    total = sum(shard.lengths)
    lengths = np.array(shard.lengths, np.int64)
    damp = lexical.dampening(lengths, len(docs), total)
    rows = [r for batch in shard.rows(0, len(docs), total, block) for r in batch.to_pylist()]
    own = {r["term"]: Postings(r["head"], r["data"], damp) for r in rows if r["term"]}
    weights = {r["term"]: lexical.weight(r["n"], len(docs)) for r in rows if r["term"]}
    counted = Counter(terms_of(asked.encode()))
    return [(c * weights[t], own[t]) for t, c in counted.items() if t in own]


def test_blocks_are_rejected_before_they_are_unpacked():
    rng = random.Random(1)
    docs = [(i, f"a{i} the of " + ("of " * rng.randrange(9))) for i in range(4000)]
    docs[77] = (77, "the needle in of")
    docs[78] = (78, "the needle stack of")
    lists = lists_of(docs, "the needle of", 64)
    held, scores = best_in_shard(lists, len(docs), 2, 1)
    top = Heap.empty()
    top.merge(2, scores, held, np.zeros(len(held), np.uint8))
    assert sorted(top.doc_ids.tolist()) == [77, 78]
    common = [p for _, p in lists if len(p.head) > 1]
    assert len(common) == 2 and all(len(p.held) <= 2 and p.all is None for p in common)


def test_threshold_of_earlier_shards_skips_a_shard():
    docs = [(i, f"the word{i}") for i in range(200)]
    lists = lists_of(docs, "the", 16)
    held, _ = best_in_shard(lists, len(docs), 3, 10**15)
    assert len(held) == 0 and lists[0][1].all is None and not lists[0][1].held
