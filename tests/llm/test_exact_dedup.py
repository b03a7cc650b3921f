from __future__ import annotations

import hashlib
import re

import pyarrow as pa

from utterance_guard.llm.exact_dedup import RUN, exact_dedup, keep_first, merge_runs

SCHEMA = "doc_id long, text string, kept string, n int, check string"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        key = re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "")
        groups.setdefault(key, []).append(doc_id)
    out = []
    for key, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    found = exact_dedup(docs.repartition(5)).drop("n_bytes", "check")
    return sorted(map(tuple, found.collect()), key=str), keep_first(docs)


def test_ties_nulls_empty_and_long(spark):
    long = "wörter " * 40_000
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (None, "q"), (None, "a b")]
    rows += [(7, long), (6, long.strip() + "\n"), (8, "z"), (8, "z"), (8, "y"), (9, "\x85a b")]
    found, kept = run(spark, rows)
    assert found == brute(rows)
    assert kept.columns == ["doc_id", "text", "kept", "n", "check"]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"] != long)
    assert left[:2] == [(0, "q"), (1, "a\tb")]
    assert (8, "z") in left and (8, "y") in left and (4, None) in left
    assert (3, "a  b") not in left and (5, "") not in left


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"t{i}") for i in range(900)]
    assert run(spark, rows)[0] == brute(rows)


def test_empty_table(spark):
    found, kept = run(spark, [])
    assert found == [] and kept.count() == 0


def test_runs_are_merged_across_batches():
    schema = pa.schema([(c, pa.string() if c == "digest" else pa.int64()) for c in RUN])
    schema = schema.append(pa.field("keep_id", pa.int64())).append(
        pa.field("n", pa.int64(), nullable=False)
    )
    rows = [("a", 5), ("a", 3), ("b", 9), ("b", None), ("b", 2), ("c", 1)]
    rows = [
        dict(place=0, digest=d, n_bytes=1, check=1, keep_id=i, n=1) for d, i in rows
    ]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 2], schema) for i in (0, 2, 4)]
    out = pa.Table.from_batches(merge_runs(iter(batches))).to_pylist()
    assert [(r["digest"], r["keep_id"], r["n"]) for r in out] == [
        ("a", 3, 2), ("b", 2, 3), ("c", 1, 1),
    ]
