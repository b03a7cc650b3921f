from __future__ import annotations

import re

import numpy as np
import xxhash

from utterance_guard.llm import url_filter
from utterance_guard.llm.url_filter import (
    MappedFile, RULES, build_index, filter_urls, pack, probes, unwanted_hosts,
)

SCHEMA = "page_id long, url string, host string, verdict int"


def brute(rows, blocked):
    out = []
    for page_id, url in rows:
        m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        best = None
        for verdict, rule in RULES:
            domain, start = rule.split("/", 1)
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
                if best is None or len(rule) > len(best[1]):
                    best = (verdict, rule)
        listed = bool(host) and any(k in blocked for k in probes(host, path))
        verdict = best[0] if best else "block" if listed else "allow"
        out.append((page_id, host, path, best and best[1], verdict))
    return sorted(out, key=str)


ROWS = [
    (1, "http://Example.ORG/es/x?y"), (2, "http://a.example.org/en/12"), (3, "http://x.org"),
    (4, "http://x.com/fr/"), (5, "http://x.com/de/#a"), (6, "http://xcom/de/"), (7, None), (8, ""),
    (9, "no scheme/x"), (10, "http://bad.net/a"), (11, "http://sub.bad.net?q=/"), (None, "q://bad"),
    (12, "http://good.net/page"), (13, "http://good.net/page2"), (13, "http://good.net/page"),
    (14, "http://x.net/" + "p" * 100_000), (15, "a://b://bad.net/"), (16, "http://ÄX.net/\n/z"),
]


def run(spark, rows, keys, **options):
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)
    index = build_index(spark.createDataFrame([(k,) for k in keys], "key string"), **options)
    return index, sorted(map(tuple, filter_urls(pages, index).drop("listed").collect()), key=str)


def test_rules_and_list(spark):
    keys = ["bad.net", "good.net/page", None, "", "bad.net", "äx"]
    assert run(spark, ROWS, keys)[1] == brute(ROWS, set(keys))


def test_many_files(spark):
    keys = [f"h{i}.net" for i in range(300)]
    rows = [(i, f"http://www.h{i}.net/") for i in range(0, 600, 7)]
    index, found = run(spark, rows, keys, keys_per_file=20)
    assert index.bits == 4 and len(index.names) == 16
    assert found == brute(rows, set(keys))


def test_empty(spark):
    assert run(spark, ROWS, [])[1] == brute(ROWS, set())
    assert run(spark, [], ["bad.net"])[1] == []


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda key: len(key))
    path = tmp_path / "f"
    path.write_bytes(pack([b"aa", b"bb", b"c"]))
    keys = [b"bb", b"cc", b"c", b"d", b"", b"aa"]
    found = MappedFile(str(path)).contains(keys, np.array([len(k) for k in keys], np.uint64))
    assert found.tolist() == [True, False, True, False, False, True]


def test_unwanted_hosts(spark):
    urls = ["http://free-bets.x/", "http://ads.y/1", "http://ads.y/2", "http://loads.z/", None]
    pages = spark.createDataFrame([(i, u, "", 0) for i, u in enumerate(urls)], SCHEMA)
    assert sorted(r[0] for r in unwanted_hosts(pages).collect()) == ["ads.y", "free-bets.x"]
    assert "spam" in url_filter.UNWANTED
