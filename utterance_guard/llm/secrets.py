"""Secret scan: fixed patterns, and a battery of randomness tests for everything else.

Candidates are long runs of encoding symbols outside the patterns' matches. The smallest
alphabet that holds all symbols of a run is its encoding. Three tests ask whether its symbols
look drawn at random: chi-squared for uniform use of the alphabet (in classes of five expected
symbols or more), runs above and below the alphabet's middle, and serial correlation. Fisher's
method combines their p-values, which then run from near zero (language) to uniform (random).

How often ordinary text passes depends on length: a short run has little to fail by. So each
candidate is paired with a decoy, the same number of symbols of its alphabet taken from the
text around it, written as the run is. Histograms of both, per encoding and length class over all documents, give for
every p-value the share of false discoveries among the runs that reach it, and each class gets
the widest limit that keeps this share at or under ``FALSE_SHARE``. A class with few runs may
also take the limit of all shorter ones and itself, which is never too wide. The histograms
have a fixed number of cells; only they come to the driver.

Defined results: a null text is an empty one. Rows are judged one by one, repeated ones too. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import small_batches, written

# Fixed patterns: kind, pattern, least length of the group (0: the match).
PATTERNS = (
    (
        "assign",
        re.compile(
            r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
            r"([A-Za-z0-9+/_.=-]+)",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: From the smallest alphabet to the largest.
ENCODINGS = (
    ("random_hex", DIGITS + "abcdef"),
    ("random_hex", DIGITS + "ABCDEF"),
    ("random_base32", UPPER + "234567"),
    ("random_base64", UPPER + LOWER + DIGITS + "+/"),
    ("random_base64url", UPPER + LOWER + DIGITS + "-_"),
)
KINDS = ("assign", "access", "hex", "random_hex", "random_base32", "random_base64",
         "random_base64url")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Least lengths of the length classes.
LENGTHS = (20, 24, 32, 40, 64, 128)
PER_CLASS = 5
FALSE_SHARE = 0.05
#: Cells of p: a tenth of a power of ten each. A limit is never beyond p = 0.01.
CELLS, WIDEST = 200, 20
#: Decoys come from so many characters per symbol before the run, or else after it.
REACH = 64
OUTSIDE = [re.compile(f"[^{re.escape(a)}]+") for _, a in ENCODINGS]
INSIDE = [re.compile(f"[{re.escape(a)}]+") for _, a in ENCODINGS]
BREAK = re.compile(r"[-_/+]")
INDEX = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the pattern matches that are long enough."""
    return [
        (m.start(), kind, m.end())
        for kind, (_, pattern, group, least) in enumerate(PATTERNS)
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def encoding_of(run: str) -> int | None:
    return next((i for i, a in enumerate(INSIDE) if a.fullmatch(run)), None)


def decoy(text: str, start: int, end: int, encoding: int) -> str | None:
    """As many symbols of the encoding as the run has, out of the text before or after it. Where
    the run has marks between its words, the text's word breaks become that mark."""
    n = end - start
    mark = BREAK.search(text, start, end)
    before, after = text[max(0, start - REACH * n) : start], text[end : end + REACH * n]
    if mark:
        before, after = (re.sub(r"\s+", mark[0], t) for t in (before, after))
    before = OUTSIDE[encoding].sub("", before)
    if len(before) >= n:
        return before[-n:]
    after = OUTSIDE[encoding].sub("", after)
    return after[:n] if len(after) >= n else None


def _two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z.tolist()])


def _chi_squared_tail(value: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Upper tail by Wilson and Hilferty's cube root."""
    c = 2 / (9 * freedom)
    z = ((value / freedom) ** (1 / 3) - (1 - c)) / np.sqrt(c)
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z.tolist()])


def _classes(symbols: int, length: int) -> int:
    return min(symbols, max(2, length // PER_CLASS))


def random_p(runs: list[tuple[str, int]]) -> np.ndarray:
    """Combined p-values of runs, given with their encodings."""
    if not runs:
        return np.zeros(0)
    n = len(runs)
    length = np.array([len(r) for r, _ in runs])
    symbols = np.array([len(ENCODINGS[e][1]) for _, e in runs])
    classes = np.array([_classes(len(ENCODINGS[e][1]), len(r)) for r, e in runs])
    own = np.repeat(np.arange(n), length)
    x = np.array([INDEX[e][c] for r, e in runs for c in r])

    widest = int(symbols.max())
    seen = np.bincount(own * widest + x * classes[own] // symbols[own], minlength=n * widest)
    every = np.arange(widest)[None, :]
    to_class = np.where(every < symbols[:, None], every * classes[:, None] // symbols[:, None], -1)
    row = np.repeat(np.arange(n), widest)[to_class.ravel() >= 0]
    share = np.bincount(row * widest + to_class[to_class >= 0], minlength=n * widest)
    expected = share.reshape(n, widest) * (length / symbols)[:, None]
    gap = np.where(expected > 0, (seen.reshape(n, widest) - expected) ** 2, 0)
    chi = (gap / np.maximum(expected, 1e-9)).sum(1)
    p_chi = _chi_squared_tail(chi, classes - 1)

    same = own[1:] == own[:-1]
    high = x * 2 >= symbols[own]
    ones = np.bincount(own, high, n)
    changes = np.bincount(own[1:], same & (high[1:] != high[:-1]), n)
    mean = 2 * ones * (length - ones) / length + 1
    spread = (mean - 1) * (mean - 2) / (length - 1)
    varied = spread > 0
    z = (changes + 1 - mean) / np.sqrt(np.where(varied, spread, 1))
    p_runs = np.where(varied, _two_sided(z), 0)

    off = x - (np.bincount(own, x, n) / length)[own]
    power = np.bincount(own, off * off, n)
    moved = np.bincount(own[1:], same * off[1:] * off[:-1], n)
    z = np.where(power > 0, moved / np.where(power > 0, power, 1), 1) * np.sqrt(length)
    p_serial = np.where(power > 0, _two_sided(z), 0)

    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return np.exp(-half) * (1 + half + half * half / 2)


def cell(p: np.ndarray) -> list[int]:
    return np.minimum(-10 * np.log10(np.maximum(p, 1e-300)), CELLS - 1).astype(int).tolist()


def stratum(encoding: int, length: int) -> int:
    return encoding * len(LENGTHS) + bisect_right(LENGTHS, length) - 1


SPANS = "array<struct<start: int, kind: int, stop: int>>"
FOUND = (
    f"doc_id long, base {SPANS}, "
    "runs array<struct<start: int, kind: int, stop: int, stratum: int, cell: int>>, "
    "decoys array<struct<stratum: int, cell: int>>"
)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans, candidate runs and decoys of each document."""
    for batch in batches:
        base, runs, decoys, judged = [], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            base.append([dict(zip(("start", "kind", "stop"), s)) for s in spans])
            runs.append([])
            decoys.append([])
            for m in CANDIDATE.finditer(text):
                start, end = m.span()
                encoding = encoding_of(m[0])
                if encoding is None or any(a <= start and end <= b for a, _, b in spans):
                    continue
                place = stratum(encoding, end - start)
                kind = KINDS.index(ENCODINGS[encoding][0])
                runs[-1].append({"start": start, "kind": kind, "stop": end, "stratum": place})
                judged.append((m[0], encoding, runs[-1][-1]))
                if (other := decoy(text, start, end, encoding)) is not None:
                    decoys[-1].append({"stratum": place})
                    judged.append((other, encoding, decoys[-1][-1]))
        for (_, _, row), c in zip(judged, cell(random_p([j[:2] for j in judged]))):
            row["cell"] = c
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, (base, runs, decoys), TYPES)],
            names=["doc_id", "base", "runs", "decoys"],
        )


_SPAN = [("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]
_CELL = [("stratum", pa.int32()), ("cell", pa.int32())]
TYPES = [pa.list_(pa.struct(f)) for f in (_SPAN, _SPAN + _CELL, _CELL)]


def widest_cell(targets: np.ndarray, decoys: np.ndarray, share: float) -> int:
    """The last cell up to which false discoveries stay within ``share``; -1 for none."""
    t, d = np.cumsum(targets)[: WIDEST + 1], np.cumsum(decoys)[: WIDEST + 1]
    fine = np.flatnonzero((d + 1) <= share * t)
    return int(fine[-1]) if fine.size else -1


def limits(targets: np.ndarray, decoys: np.ndarray, share: float = FALSE_SHARE) -> list[int]:
    """A limit for each stratum from counts by stratum and cell."""
    n, out = len(LENGTHS), []
    for e in range(len(ENCODINGS)):
        for k in range(n):
            own = slice(e * n + k, e * n + k + 1)
            shorter = slice(e * n, e * n + k + 1)
            out.append(
                max(widest_cell(targets[s].sum(0), decoys[s].sum(0), share) for s in (own, shorter))
            )
    return out


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``."""
    small_batches(docs.sparkSession)
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")
    )
    found = written(plain.mapInArrow(scan, FOUND), "secret-runs")

    def cells(column: str, target: int) -> DataFrame:
        own = F.explode(column).alias("x")
        return found.select(own).select("x.stratum", "x.cell", F.lit(target).alias("target"))

    counts = np.zeros((2, len(ENCODINGS) * len(LENGTHS), CELLS))
    both = cells("runs", 1).unionAll(cells("decoys", 0))
    for r in both.groupBy("stratum", "cell", "target").count().collect():
        counts[r["target"], r["stratum"], r["cell"]] = r["count"]
    limit = F.array(*map(F.lit, limits(counts[1], counts[0])))
    passed = F.filter("runs", lambda r: r["cell"] <= limit[r["stratum"]])
    added = F.transform(passed, lambda r: F.struct(r["start"], r["kind"], r["stop"]))

    def joined(spans):
        name = F.array(*map(F.lit, KINDS))
        parts = F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["stop"]),
        )
        return F.array_join(parts, ",")

    def count(kind: str):
        wanted = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == wanted)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k, *_ in PATTERNS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", added.cast(SPANS))).alias("spans"),
        F.size(added).cast("long").alias("n_random"),
    )
