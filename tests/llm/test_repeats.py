from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from utterance_guard.llm import repeats
from utterance_guard.llm.repeats import COLUMNS, pack, remove_repeats, stretches, unpack

SCHEMA = "doc_id long, text string, kind int, bucket string"


def brute(rows):
    data = [(doc, (text or "").encode()) for doc, text in rows]
    first = {}
    for doc, own in data:
        for i in range(len(own) - 49):
            key, rank = own[i : i + 50], float("inf") if doc is None else doc
            first[key] = min(rank, first.get(key, rank))
    out = []
    for doc, own in data:
        gone = bytearray(len(own))
        for i in range(len(own) - 49):
            if first[own[i : i + 50]] < (float("inf") if doc is None else doc):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(own, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(own), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, remove_repeats(docs).collect()), key=str)


def corpus(seed, n=90, letters="abc de"):
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choices(letters, k=k))
    shared = [prose(rng.randrange(30, 160)) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            part = rng.choice(shared)
            a, b = sorted((rng.randrange(len(part)), rng.randrange(len(part))))
            parts.append(rng.choice((prose(rng.randrange(70)), part, part[a:b], "ü" * 3 + part)))
        rows.append((rng.randrange(10**6), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(5, None), (6, ""), (None, rows[0][1]), (None, rows[1][1]), (7, rows[2][1])]
    rows += [(7, rows[2][1]), (7, rows[3][1]), (8, "x" * 49), (9, "x" * 50), (4, "x" * 50)]
    rows += [(10, "x" * 300), (11, "ab" * 200), (12, "ab" * 90), (-3, "ab" * 26)]
    wanted = brute(rows)
    assert sum(w[2] > 0 for w in wanted) > 30
    assert run(spark, rows) == wanted


def test_few_letters(spark):
    """Periodic and near-periodic texts: many ties among samples and names."""
    rng = random.Random(3)
    rows = [
        (i, "".join(rng.choice(("aab", "aab", "aab", "a", "b" * 20)) for _ in range(60)))
        for i in range(60)
    ]
    assert run(spark, rows) == brute(rows)


def test_long_texts_are_cut_into_chunks(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ", k=1_300_000))
    rows = [(2, long), (3, "z" * 37 + long[1_000_000:1_200_000] + "q"), (1, long[900:1100])]
    found = run(spark, rows)
    by_id = {r[0]: r for r in found}
    assert by_id[1][2] == 0 and by_id[2][2:4] == (200, 1) and by_id[3][2:4] == (200_000, 1)


def test_a_passage_everywhere(spark):
    rows = [(i, f"own {i:05d} " * 6 + "the very same passage of words " * 4) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_every_suffix_lies_in_one_stretch():
    rng = random.Random(5)
    for n in (0, 49, 50, 51, 400):
        data = bytes(rng.choices(b"ab", k=n))
        own, names = stretches(data)
        covered = [i for b, c in zip(own["begin"].tolist(), own["size"].tolist()) for i in range(b, b + c)]
        assert covered == list(range(max(0, n - 49))) and len(names) == len(own["begin"])
        assert (own["at"].astype(int) < own["size"].astype(int) + repeats.STRETCH).all()


def test_packing():
    rng = np.random.default_rng(0)
    entries = {n: rng.integers(0, 1 << min(8 * w, 62), 7).astype(t) for n, (t, w) in COLUMNS.items()}
    entries["doc"][:2] = (-5, repeats.LAST_ID)
    back, tail = unpack(pack(entries, tuple(COLUMNS), b"tail"), tuple(COLUMNS))
    assert tail == b"tail" and all((back[n] == entries[n]).all() for n in COLUMNS)


def test_buckets_are_even():
    rng = random.Random(6)
    own, _ = stretches("".join(rng.choices("abcdefgh ", k=400_000)).encode())
    bucket = own["sample"] >> np.uint64(repeats.NAME_BITS - 4)
    counts = np.bincount(bucket.astype(int), minlength=16)
    assert counts.max() < 1.2 * counts.mean()
