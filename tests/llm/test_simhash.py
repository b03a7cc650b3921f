from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from utterance_guard.llm import simhash
from utterance_guard.llm.components import components
from utterance_guard.llm.simhash import (
    CHOICES, groups_by_neighbours, groups_by_pairs, hex_print, keep_smallest, near_groups,
)

SCHEMA = "doc_id long, text string, fp string, component_id int"


def print_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(doc_id, ids.get(root(i), doc_id))
    return sorted(
        ((d, f"{prints[i]:016x}", ids.get(root(i))) for i, (d, _) in enumerate(rows)), key=str
    )


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = near_groups(docs).select("doc_id", hex_print().alias("fingerprint"), "component_id")
    return docs, sorted(map(tuple, found.collect()), key=str)


def corpus():
    rng = random.Random(3)
    word = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = rng.choices(word, k=rng.choice((5, 60, 400, 900)))
        for _ in range(rng.choice((1, 2, 8))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(word)
            rows.append((rng.randrange(10**6), " ".join(copy)))
    rows += [(5, None), (3, ""), (9, " \t"), (None, "a b"), (7, "A\tB"), (None, "lone words here")]
    rows += [(8, "one two three four"), (8, "one two three four"), (8, "other"), (11, "x " * 30_000)]
    return rows


def test_groups(spark):
    rows = corpus()
    docs, found = run(spark, rows)
    assert found == brute(rows)
    kept = keep_smallest(docs)
    assert kept.columns == docs.columns
    best = {d for d, _, c in found if d == c}
    assert {r["doc_id"] for r in kept.collect()} == best


def test_rows_without_id(spark):
    """A copy without id goes where its group has one; the only one of its kind stays."""
    rows = [(1, "a b c d"), (None, "A  b c d"), (None, "quite another text"), (2, None), (None, "")]
    docs = spark.createDataFrame(
        [(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _fp int, _kept int"
    )
    kept = keep_smallest(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [
        (0, "quite another text"), (1, "a b c d"), (2, None),
    ]


def test_empty(spark):
    assert run(spark, [])[1] == []


@pytest.mark.parametrize("choice", [0, 17, 55])
def test_both_ways_through_a_list_agree(choice):
    rng = np.random.default_rng(choice)
    base = rng.integers(-(2**63), 2**63, dtype=np.int64)
    values = {int(base)}
    free = sorted(set(range(8)) - set(CHOICES[choice]))
    while len(values) < 700:
        start = rng.choice(sorted(values)) if rng.random() < 0.7 else base
        for _ in range(rng.integers(1, 6)):
            start ^= np.int64(np.uint64(1) << np.uint64(8 * rng.choice(free) + rng.integers(8)))
        values.add(int(start))
    values = np.array(sorted(values), np.int64)
    a, b = groups_by_pairs(values), groups_by_neighbours(values, CHOICES[choice])
    same = lambda x: (x[:, None] == x[None, :])
    assert (same(a) == same(b)).all() and len(set(a.tolist())) > 1


def test_long_lists_in_the_job(spark, monkeypatch):
    """Many fingerprints that agree in five bytes; workers read the limit from the closure."""
    rng = random.Random(5)
    fps = sorted({rng.getrandbits(24) for _ in range(3000)} | {-1, -2, 1 << 62})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.posted(table, 4).mapInArrow(simhash.link_lists, "u long, v long")
    root = {r["u"]: r["v"] for r in components(links).collect()}
    values = np.array(fps, np.int64)
    wanted = groups_by_pairs(values)
    assert {f: root.get(f, f) for f in fps} == {
        f: int(values[wanted == wanted[i]].min()) for i, f in enumerate(fps)
    }


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (7, 7), (300, 100)]
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r["u"], r["v"]) for r in found} == {(i, 1) for i in range(2, 41)} | {
        (200, 100), (300, 100),
    }
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
