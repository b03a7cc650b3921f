"""The pipeline's stages against brute force, on tables made for it."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_exact_dedup import brute as groups
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_simhash import brute as near_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def corpus():
    rng = random.Random(11)
    part = "the of was tion ing er st on in re ha and".split()
    word = [a + b for a in part for b in part]
    prose = lambda n: " ".join(rng.choices(word, k=n)) + "."
    text = lambda: " ".join(prose(9) for _ in range(8))
    items = [(i, prose(25)) for i in range(4)]
    rows, labels, junk = [], [], set()
    for i in range(160):
        kind = ("good", "good", "shout", "abuse", "copy", "near", "leak", "good")[i % 8]
        own = text()
        if kind == "shout":
            own = "!! ".join(own.upper().split()) + "!!"
        if kind == "abuse":
            own += " " + " ".join(rng.sample(("zork", "blorf", "gnah", "fitz"), 3))
        if kind in ("copy", "near"):
            own = rows[rng.randrange(0, i // 8 * 8 + 2) // 8 * 8][1]
            own = own.replace(" ", "  ", 3) if kind == "copy" else "Plus " + own
        if kind == "leak":
            own += " " + rng.choice(items)[1]
        if kind in ("shout", "abuse"):
            junk.add(i)
        rows.append((i, own, "en", f"s{i % 3}", len(own), 0))
        labels.append((i, int(kind != "shout"), int(kind == "abuse")))
    rows += [(500, None, None, None, None, None), (501, "", "en", "s1", 0, 0)]
    rows += [(None, text(), "en", None, 1, 0), (502, text() + " x" * 9, "en", "s9", 1, 0)]
    return rows, [x for x in labels if x[0] % 3], items, junk | {500, 501}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items, junk = corpus()
    for name, data, schema in (
        ("documents", rows, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEMS),
    ):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after.append(docs)
    return spark, folder, rows, items, junk, after


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(made):
    spark, folder, rows, items, junk, after = made
    assert all(df.columns == [c.split()[0] for c in DOCS.split(", ")] for df in after[:-1])
    quality = pairs(after[0])
    assert {i for i, _ in quality} == {r[0] for r in rows} - junk
    exact = pairs(after[1])
    kept = {(d, sha) for d, _, _, k, sha in groups(quality) if k}
    assert sorted(d for d, _ in exact if d is not None) == sorted(d for d, _ in kept if d is not None)
    assert len(exact) == len(kept) < len(quality)
    near = pairs(after[2])
    assert sorted(map(str, (d for d, _, c in near_groups(exact) if d == c))) == sorted(
        str(d) for d, _ in near
    )
    clean = pairs(after[3])
    assert sorted(str(d) for d, bad, _ in leaks(near, items) if not bad) == sorted(
        str(d) for d, _ in clean
    )
    assert len(clean) < len(near)
    left = [(r["doc_id"], r["text"], r["source"]) for r in after[3].collect()]
    check_mix(left, [tuple(r) for r in after[4].collect()])


def test_run_is_the_stages_in_order(made):
    spark, folder, *_, after = made
    found = pipeline.run(spark, folder)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        map(tuple, after[-1].collect()), key=str
    )


def test_empty_table(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
