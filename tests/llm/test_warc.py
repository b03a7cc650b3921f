from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os

import pytest

from utterance_guard.llm.warc import members, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, digest string, shard int, kind int"


def brute(rows):
    smallest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            key = html or ""
            smallest[key] = min(page_id, smallest.get(key, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = smallest.get(html or "")
        again = first is not None and (page_id is None or page_id > first)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = "revisit" if again else "response"
        out.append((page_id, len(data), digest, kind, first if again else None))
    return sorted(out, key=str)


def trip(spark, folder, rows, **options):
    pages = spark.createDataFrame([(*r, "d", 1, 0) for r in rows], SCHEMA)
    manifest = write_archives(pages.repartition(3), folder, 3, **options)
    found = read_archives(manifest, folder, 2).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    return manifest, sorted(map(tuple, found.collect()), key=str)


ROWS = [
    (5, "http://a/ b\n", "same"), (2, "http://a", "same"), (9, None, "same"), (3, "u", None),
    (4, "u", ""), (1, "u", "ünï\r\n\r\nWARC/1.1\r\n"), (None, "n", "same"), (None, "n", "own"),
    (7, "r", "twice"), (7, "r", "twice"), (8, "r", "twice"), (10, "v", "x" * 300_000),
    (-(2**62), "low", "low"),
]


def test_round_trip(spark, tmp_path):
    manifest, found = trip(spark, str(tmp_path), ROWS)
    assert found == brute(ROWS)
    names = sorted(r["name"] for r in manifest.collect())
    assert names == sorted(n for n in os.listdir(tmp_path) if n.endswith(".gz"))


def test_same_files_again_and_rolling(spark, tmp_path):
    rows = [(i, f"http://h/{i}", hashlib.sha256(b"%d" % (i % 90)).hexdigest()) for i in range(120)]
    files = []
    for name in ("a", "b"):
        manifest, found = trip(spark, str(tmp_path / name), rows, file_bytes=4000)
        assert found == brute(rows)
        files.append({(r["name"], r["bytes"], r["sha1"]) for r in manifest.collect()})
    assert files[0] == files[1] and len(files[0]) > 6
    assert all(size <= 4000 for _, size, _ in files[0])


def test_small_payloads_are_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    found = trip(spark, str(tmp_path), rows, min_payload=3)[1]
    assert [r[3] for r in found] == ["response", "response", "response", "revisit"]


def test_empty_table(spark, tmp_path):
    manifest, found = trip(spark, str(tmp_path), [])
    assert manifest.count() == 0 and found == []


def test_damage_is_found(spark, tmp_path):
    manifest, _ = trip(spark, str(tmp_path), ROWS[:3])
    path = tmp_path / manifest.first()["name"]
    path.write_bytes(path.read_bytes()[:-8])
    with pytest.raises(Exception, match="cut off|manifest"):
        read_archives(manifest, str(tmp_path), 1).collect()


def test_members():
    parts = [b"a", b"b" * 5000, b""]
    data = b"".join(gzip.compress(p) for p in parts)
    assert list(members(io.BytesIO(data), 7)) == parts
