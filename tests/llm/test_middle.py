from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterance_guard.llm import middle
from utterance_guard.llm.middle import PLAIN, PSM, SPM, Rule, cut_and_move, digests_of
from utterance_guard.llm.middle import fill_in_middle, move_back, restore

SCHEMA = "doc_id long, text string, form string, output int, n string"


def brute(doc_id, text, rule=Rule()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rule.share:
        return doc_id, n, PLAIN, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < rule.spm:
        return doc_id, n, SPM, len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, PSM, len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def run(spark, rows, rule=Rule()):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    both = restore(fill_in_middle(docs, rule)).collect()
    got = [(*r[:5], bytes(r["output"]).decode()) for r in both]
    assert sorted((r["doc_id"] or -1, bytes(r["restored"]).decode()) for r in both) == sorted(
        (i or -1, t or "") for i, t in rows
    )
    return sorted(got, key=str)


ROWS = [
    (0, None), (1, ""), (2, "one line"), (3, "\n"), (4, "a\nb\nc"), (5, "a\nb\nc\n"),
    (6, "has <P> inside\nx"), (7, "<\nP>\n<S\n>"), (8, "ü\nñandú 😀\n\n\nend"), (8, "ü\n"),
    (8, "ü\n"), (None, "no\nid\n"), (9, "<M>"), (10, "M>\n<"), (11, "\n\n\n\n"),
]


@pytest.mark.parametrize("rule", [Rule(), Rule(seed=1, share=60, spm=0), Rule(spm=100)])
def test_rows(spark, rule):
    rows = ROWS + [(i, "zeile\n" * (i % 7) + "x" * (i % 3)) for i in range(20, 120)]
    found = run(spark, rows, rule)
    assert found == sorted((brute(i, t, rule) for i, t in rows), key=str)
    assert {r[2] for r in found} >= {PLAIN}


def test_long_text(spark):
    rows = [(i, "".join(f"línea {j}\n" for j in range(i * 90_000))) for i in (1, 2, 3)]
    assert run(spark, rows) == sorted((brute(i, t) for i, t in rows), key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert digests_of(empty).count() == 0


def test_draws_do_not_depend_on_partitions(spark):
    rows = [(i, f"a{i}\nb\nc\nd{i % 3}\n") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(digests_of(docs.repartition(n)).collect()) for n in (1, 7))
    assert one == many


def buffers(texts):
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), offsets


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text("ab\n<P>SMü😀", max_size=30), min_size=1, max_size=6),
    st.randoms(use_true_random=False),
    st.sampled_from([1, 3, 16, 1 << 20]),
)
def test_blocks_and_draws(texts, rng, block):
    draws = np.array([[rng.randrange(1 << 32) for _ in range(4)] for _ in texts], np.int64)
    raw, offsets = buffers(texts)
    was, middle.BLOCK = middle.BLOCK, block
    try:
        out, ends, n, form, prefix, mid = cut_and_move(raw, offsets, draws, Rule(share=80))
        back, back_ends = move_back(out, ends, form != 0)
    finally:
        middle.BLOCK = was
    assert back.tobytes() == raw.tobytes() and (back_ends == offsets).all()
    for i, text in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert n[i] == len(units)
        own = out[ends[i] : ends[i + 1]].tobytes().decode()
        if form[i]:
            a, b = sorted(int(x) % (len(units) + 1) for x in draws[i, :2])
            p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
            assert own == (f"<P>{p}<S>{s}<M>{m}" if form[i] == 1 else f"<S>{s}<P>{p}<M>{m}")
            assert (prefix[i], mid[i]) == (len(p), len(m))
        else:
            assert own == text


def test_broken_output_is_an_error():
    raw, offsets = buffers(["<P>a<S>b", "x"])
    with pytest.raises(ValueError):
        move_back(raw, offsets, np.array([True, False]))
    raw, offsets = buffers(["<P>a<P>b<M>c"])
    with pytest.raises(ValueError):
        move_back(raw, offsets, np.array([True]))
