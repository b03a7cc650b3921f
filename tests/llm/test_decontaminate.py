from __future__ import annotations

import random

import pytest

from utterance_guard.llm.decontaminate import (
    Index, aligned, budget, find_leaks, plain, segments, without_leaks,
)

DOCS = "doc_id long, text string, leaks int, _leaks string"
ITEMS = "item_id long, text string, doc_id int"


def distance(wanted, text):
    """Least edits between ``wanted`` and any part of ``text``, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(wanted, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        data = plain((text or "").encode())
        hits = [
            i for i, t in items
            for s in segments(plain((t or "").encode())) if distance(s, data) <= budget(len(s))
        ]
        out.append((doc_id, bool(hits), sorted({h for h in hits if h is not None})))
    return sorted(out, key=str)


def edit(rng, text, n):
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:at] + ("", "q", "q" + text[at : at + 1])[kind] + text[at + (kind < 2) :]
    return text


def make(seed):
    rng = random.Random(seed)
    syllables = "the an er ing tion of and re he st en or".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 3))))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.choice((4, 14, 30)))) for i in range(12)]
    docs = []
    for i in range(40):
        text = prose(30)
        if i % 2:
            leak = edit(rng, rng.choice(items)[1], rng.choice((0, 1, 5, 9, 14)))
            text += " " + rng.choice((leak, leak.upper(), leak.replace(" ", " \n "))) + " "
        docs.append((i, text + prose(20)))
    return docs, items


@pytest.mark.parametrize("blocks", [1, 3])
def test_against_brute_force(spark, blocks):
    docs, items = make(2)
    docs += [(100, None), (101, ""), (None, items[3][1]), (3, "short"), (3, "short")]
    items += [(50, None), (51, ""), (52, "tiny"), (None, "a passage that has no number at all")]
    docs += [(102, "so A passage  that has no number at all")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    wanted = brute(docs, items)
    assert 5 < sum(w[1] for w in wanted) < 30
    if blocks == 1:
        found = find_leaks(frame, bench).drop("n_items")
        assert sorted(map(tuple, found.collect()), key=str) == wanted
        left = without_leaks(frame, bench)
        assert left.columns == frame.columns
        assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(
            str(w[0]) for w in wanted if not w[1]
        )
    else:
        from utterance_guard.llm.decontaminate import with_leaks

        found = with_leaks(frame.select("doc_id", "text"), bench, "hit", block_bytes=1200)
        rows = [(r["doc_id"], r["hit"]["found"], r["hit"]["items"]) for r in found.collect()]
        assert sorted(rows, key=str) == wanted


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", 0, "")], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert find_leaks(docs, none).first()["contaminated"] is False
    assert find_leaks(docs.limit(0), none).count() == 0
    assert without_leaks(docs, none).count() == 1


def test_alignment():
    rng = random.Random(1)
    for _ in range(40):
        a, b = (bytes(rng.choices(b"ab c", k=rng.randrange(n))) for n in (12, 30))
        assert aligned(a, b) == distance(a, b)


def test_across_chunks(monkeypatch):
    from utterance_guard.llm import decontaminate

    monkeypatch.setattr(decontaminate, "CHUNK", 500)
    rng = random.Random(4)
    item = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(25))
    index = Index.of([{"item_id": 1, "text": item}])
    for at in range(300, 1100, 37):
        text = ("lorem ipsum dolor " * 100)[:at] + item + " dolor" * 300
        assert len(index.leaks(text.encode())) == len(segments(item.encode()))
