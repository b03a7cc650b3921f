from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from utterance_guard.llm.mixing import Source, draw, mix_sources, permute, taken_words, targets

SCHEMA = "doc_id long, text string, source string, size string, taken int, target string"


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    mix = mix_sources(docs.repartition(3), **options)
    return mix, [tuple(r) for r in taken_words(mix).collect()]


def check(rows, found):
    """What holds for every mix, from the rules alone."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, source), n in zip(rows, sizes):
        total[source] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, targets([total[s] for s in names])))
    by_id = Counter((i, n, total[s], wanted[s]) for (i, _, s), n in zip(rows, sizes))
    assert Counter(r[:4] for r in found) == by_id
    assert all(0 <= r[4] <= 2 * r[1] for r in found)
    for name in names:
        ids = {(i, n) for (i, _, s), n in zip(rows, sizes) if s == name}
        taken = sum(r[4] for r in found if r[:2] in ids and r[3] == wanted[name])
        assert abs(taken - wanted[name]) <= 0.5, name


def test_targets():
    assert targets([]) == [] and targets([0, 0]) == [0, 0]
    assert targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    given = targets([10, 1000, 1000, 5, 0])
    assert sum(given) == pytest.approx(1.5 * 2015)
    assert given[0] == 20 and given[3] == 10 and given[4] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000])
def test_permutation(n):
    for key in (0, 7):
        i = np.arange(n)
        out = permute(i, np.full(n, n), np.full(n, key))
        assert sorted(out) == i.tolist()
        assert (permute(out, np.full(n, n), np.full(n, key), back=True) == i).all()


def test_draw_gives_every_slot():
    sources = [Source(i, str(i), 0, 0, 10, s) for i, s in enumerate((100, 0, 7, 1))]
    rows = draw(sources, 10, 3)
    assert rows == draw(sources, 10, 3)
    assert Counter({i: sum(r[3] for r in rows if r[1] == i) for i in (0, 2, 3)}) == Counter(
        {0: 100, 2: 7, 3: 1}
    )
    assert max(Counter(r[0] for r in rows for _ in range(r[3])).values()) == 10


def test_mix(spark):
    rows = [(i, words(i % 37), ("a", "b", None, "Z")[i % 4]) for i in range(200)]
    rows += [(1000, words(5000), "a"), (1001, None, "b"), (None, words(9), "c"), (5, "x y", "é")]
    rows += [(7, words(11), "b")] * 3 + [(8, "", "zero")] * 2 + [(9, " \t\n", None)]
    first, found = run(spark, rows, block_words=8, shard_slots=50)
    check(rows, found)
    again = run(spark, rows, block_words=8, shard_slots=50)[1]
    assert sorted(found, key=str) == sorted(again, key=str)
    pieces = first.pieces.collect()
    slots = Counter()
    for p in pieces:
        assert 0 <= p["begin"] < p["end"]
        slots[p["index"], p["slot"]] += p["end"] - p["begin"]
    assert max(slots.values()) == 8


def test_production_parameters_on_small_sources(spark):
    sizes = [(3, "a"), (1, "b"), (700, "c"), (9, "c")]
    rows = [(i, words(n), s) for i, (n, s) in enumerate(sizes)]
    check(rows, run(spark, rows)[1])


def test_empty(spark):
    assert run(spark, [])[1] == []
    found = run(spark, [(1, None, None), (2, "", "a")])[1]
    assert sorted(found) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
