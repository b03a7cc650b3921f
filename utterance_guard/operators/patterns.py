"""An index over all entries of a lexicon, searched once per text.

All substring entries become one automaton (Aho-Corasick), and all phrases another. A text is
read once, whatever the number of entries, and every entry in it is found, also where one lies
within another. Workers build the automata once from broadcast entries, so the entries'
characters are measured before: up to ``INDEX_CHARS`` an automaton takes some 300 MB.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterance_guard.sources.files import PHRASE, SUBSTRING

INDEX_CHARS = 4_000_000
INDEX_ENTRIES = 500_000
PART, ORD, SOURCE, WORD = range(4)
ARROW_HIT = pa.struct(
    [("part", pa.int32()), ("ord", pa.int64()), ("source", pa.string()), ("word", pa.string())]
)


def entries_if_small(
    lexicon: DataFrame, chars: int = INDEX_CHARS, entries: int = INDEX_ENTRIES
) -> list[Row] | None:
    """All entries when an index of them fits a worker, else None; measured before a row of
    them is collected."""
    size = lexicon.agg(
        F.count("*").alias("n"), F.sum(F.char_length("word")).alias("chars")
    ).first()
    if size["n"] > entries or (size["chars"] or 0) > chars:
        return None
    return lexicon.select("mode", "ord", "source", "word").collect()


class PatternIndex:
    """Positions in a sorted list of entries, by the words found in a text."""

    def __init__(self, words: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            places.setdefault(word, []).append(i)
        for word, own in places.items():
            self.automaton.add_word(word, tuple(own))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[int]:
        if not text or not len(self.automaton):
            return []
        found = {own for _, own in self.automaton.iter(text)}
        return sorted(i for own in found for i in own)


class Matcher:
    """Hits of normalised texts and phrase forms, as the lists that ``blocklist`` gives."""

    def __init__(self, substrings: list[tuple], phrases: list[tuple], marker: str):
        self.words = PatternIndex(word for _, _, word in substrings)
        self.phrases = PatternIndex(f" {word} " for _, _, word in phrases)
        self.phrase_rows = phrases
        self.marker = marker
        rows = [(0, *row) for row in substrings]
        # a phrase list gives one hit: its first entry that was found stands for all
        rows += [(1, ord_, source, marker) for ord_, source, _ in phrases]
        columns = list(zip(*rows)) if rows else [[]] * 4
        self.hits = pa.StructArray.from_arrays(
            [pa.array(c, t.type) for c, t in zip(columns, ARROW_HIT)], fields=list(ARROW_HIT)
        )
        self.offset = len(substrings)

    def one(self, normal: str | None, padded: str | None) -> list[int]:
        first: dict[str, int] = {}
        for i in self.phrases.find(padded):
            first.setdefault(self.phrase_rows[i][1], i)
        return self.words.find(normal) + [self.offset + i for i in sorted(first.values())]

    def all(self, normal: pa.Array, padded: pa.Array) -> pa.Array:
        found = [self.one(n, p) for n, p in zip(normal.to_pylist(), padded.to_pylist())]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = pa.array([i for own in found for i in own], pa.int64())
        return pa.ListArray.from_arrays(pa.array(ends), self.hits.take(flat))


# What this worker process has built; one lexicon at a time is in use.
_BUILT: dict[str, Matcher] = {}


def matcher(key: str, entries) -> Matcher:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(*entries.value)
    return _BUILT[key]


def indexed_hits(
    df: DataFrame, rows: list[Row], marker: str, hit_type: T.DataType, normal: str, padded: Column
) -> Column:
    """The hits of each row, in order of part, ord, source and word."""

    def of(mode: str) -> list[tuple]:
        return sorted((r["ord"], r["source"], r["word"]) for r in rows if r["mode"] == mode)

    key = uuid.uuid4().hex
    held = df.sparkSession.sparkContext.broadcast((of(SUBSTRING), of(PHRASE), marker))

    @F.arrow_udf(hit_type)
    def hits(texts: pa.Array, forms: pa.Array) -> pa.Array:
        return matcher(key, held).all(texts, forms)

    # not deterministic, so that no filter asks a second time
    return hits.asNondeterministic()(F.col(normal), padded)
