"""Lexicon matching: which entries occur in a text.

Three plans give the same hits.

* A lexicon of up to ``INLINE_LIMIT`` entries becomes part of the projection: each text is
  tested against each word, in place, with no join and no shuffle.
* A larger one becomes an index over all words, which workers hold and each text is searched
  for once (``patterns``). No join and no shuffle either, on a batch as on a stream; entries are
  measured before they are sent out.
* One beyond that is joined on anchors, the first few characters of a word. A text's distinct
  pieces of that length meet the words that begin so, and those words are sought in the text.
  Phrases are anchored on their first token. The lexicon is broadcast while its measured size
  allows, and only hits are shuffled then. Past that row ids and pieces are shuffled and meet
  the lexicon; anchors that occur in a large part of all texts are found first, and salted.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterance_guard.functions.text import normalize, phrase_form
from utterance_guard.operators.patterns import INDEX_CHARS, entries_if_small, indexed_hits
from utterance_guard.operators.sizes import fits_broadcast, rows_if_few
from utterance_guard.operators.skew import skewed_join
from utterance_guard.operators.stages import settle
from utterance_guard.sources.files import PHRASE, SUBSTRING

INLINE_LIMIT = 128
ANCHOR_CHARS = 6
PHRASE_MARKER = "[phrase]"

HITS = T.ArrayType(
    T.StructType()
    .add("part", T.IntegerType())
    .add("ord", T.LongType())
    .add("source", T.StringType())
    .add("word", T.StringType())
)


def blocklist(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    marker: str = PHRASE_MARKER,
    inline_limit: int = INLINE_LIMIT,
    can_broadcast: bool | None = None,
    index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """Add ``matched``, ``matched_words``, ``matched_sources`` and ``normal_text``.

    Substring entries are sought in the normalised text, each one found is a hit. Phrase
    entries are sought in the raw text, as whole tokens whatever their case; a phrase list
    adds one marker and its source once, after the substring hits. ``row_id`` must be unique.
    """
    usable = lexicon.filter(F.col("word") != "")
    few = rows_if_few(usable, inline_limit)
    prepared = df.withColumn("normal_text", normalize(text))
    held_entries = entries_if_small(usable, index_chars) if few is None else None
    if held_entries is not None:
        any_phrase = any(e["mode"] == PHRASE for e in held_entries)
        padded = phrase_form(text) if any_phrase else F.lit(None).cast("string")
        found = prepared.withColumn(
            "hits", indexed_hits(df, held_entries, marker, HITS, "normal_text", padded)
        )
    elif few is None:
        if df.isStreaming:
            raise ValueError("a lexicon this large needs alert_stream, which works by batches")
        hits = _joined_hits(prepared, usable, text, row_id, marker, can_broadcast)
        found = prepared.join(hits, row_id, "left").withColumn(
            "hits", F.coalesce("hits", F.array().cast(HITS))
        )
    else:
        held = prepared.withColumn("phrase_text", _phrase_candidates(few, text))
        found = settle(held, hits=_inline_hits(few, marker))
    return found.select(
        *prepared.columns,
        (F.size("hits") > 0).alias("matched"),
        F.col("hits.word").alias("matched_words"),
        F.col("hits.source").alias("matched_sources"),
    )


def _inline_hits(entries: list, marker: str) -> Column:
    ordered = sorted(entries, key=lambda e: (e["ord"], e["source"], e["word"]))

    def literal(part: int, e, word: str) -> Column:
        return F.struct(
            F.lit(part).alias("part"),
            F.lit(e["ord"]).cast("long").alias("ord"),
            F.lit(e["source"]).alias("source"),
            F.lit(word).alias("word"),
        )

    def any_phrase(source: str) -> Column:
        # spelled out, since inside a lambda the optimizer may redo phrase_form per phrase
        padded = [f" {e['word']} " for e in phrases if e["source"] == source]
        return reduce(operator.or_, [F.contains("phrase_text", F.lit(p)) for p in padded])

    parts = []
    words = [literal(0, e, e["word"]) for e in ordered if e["mode"] == SUBSTRING]
    if words:
        # a text may be null, and a filter on a null condition keeps nothing
        parts.append(
            F.filter(F.array(*words), lambda e: F.contains("normal_text", e["word"]))
        )
    phrases = [e for e in ordered if e["mode"] == PHRASE]
    for source in dict.fromkeys(e["source"] for e in phrases):
        first = next(e for e in phrases if e["source"] == source)
        parts.append(
            F.when(any_phrase(source), F.array(literal(1, first, marker))).otherwise(
                F.array().cast(HITS)
            )
        )
    return F.concat(*parts) if parts else F.array().cast(HITS)


def _phrase_candidates(entries: list, text: str) -> Column:
    """The phrase form of texts that have all tokens of some phrase, null for the others: a
    search for the tokens is much cheaper than that form."""
    lowered = F.lower(text)
    tests = [
        reduce(operator.and_, [F.contains(lowered, F.lit(t)) for t in e["word"].split(" ")])
        for e in entries
        if e["mode"] == PHRASE
    ]
    if not tests:
        return F.lit(None).cast("string")
    return F.when(reduce(operator.or_, tests), phrase_form(text))


def _joined_hits(
    df: DataFrame,
    lexicon: DataFrame,
    text: str,
    row_id: str,
    marker: str,
    can_broadcast: bool | None,
) -> DataFrame:
    """``row_id, hits`` for the rows with a hit. Equal entries are one row with a count here,
    and as many hits in the end."""
    entries = lexicon.groupBy("mode", "ord", "source", "word").agg(F.count("*").alias("times"))
    substrings = entries.filter(F.col("mode") == SUBSTRING).select(
        F.substring("word", 1, ANCHOR_CHARS).alias("key"),
        F.col("word").alias("needle"),
        "ord",
        "source",
        "times",
    )
    phrases = entries.filter(F.col("mode") == PHRASE).select(
        F.substring_index("word", " ", 1).alias("key"),
        F.concat(F.lit(" "), "word", F.lit(" ")).alias("needle"),
        "ord",
        "source",
        "times",
    )
    sizes = substrings.select(F.char_length("key").alias("n")).distinct().collect()
    hits = None
    if sizes:
        # one code point at a time, so that no character is cut in two
        grams = [
            F.regexp_extract_all("hay", F.lit(f"(?s)(?=(.{{{r['n']}}}))."), F.lit(1))
            for r in sorted(sizes)
        ]
        pieces = F.array_distinct(F.concat(*grams))
        hay = df.select(row_id, F.col("normal_text").alias("hay"))
        hits = _anchored(hay, pieces, substrings, row_id, can_broadcast).select(
            row_id, F.lit(0).alias("part"), "ord", "source", F.col("needle").alias("word"), "times"
        )
    if not phrases.isEmpty():
        hay = df.select(row_id, phrase_form(text).alias("hay"))
        pieces = F.array_distinct(F.split(F.btrim("hay"), " "))
        once = (
            _anchored(hay, pieces, phrases, row_id, can_broadcast)
            .groupBy(row_id, "source")
            .agg(F.min("ord").alias("ord"))
            .select(
                row_id,
                F.lit(1).alias("part"),
                "ord",
                "source",
                F.lit(marker).alias("word"),
                F.lit(1).cast("long").alias("times"),
            )
        )
        hits = once if hits is None else hits.unionByName(once)
    if hits is None:
        return df.select(row_id, F.array().cast(HITS).alias("hits")).limit(0)
    # a list is no longer than the number of entries its own text contains
    found = F.sort_array(F.collect_list(F.struct("part", "ord", "source", "word", "times")))

    def repeated(e: Column) -> Column:
        return F.array_repeat(
            F.struct(e["part"], e["ord"], e["source"], e["word"]), e["times"].cast("int")
        )

    return hits.groupBy(row_id).agg(
        F.flatten(F.transform(found, repeated)).cast(HITS).alias("hits")
    )


def _anchored(
    hay: DataFrame,
    pieces: Column,
    entries: DataFrame,
    row_id: str,
    can_broadcast: bool | None,
) -> DataFrame:
    """Entries that a text contains: those whose key is among its distinct pieces are sought
    in it. A row per text and entry."""
    if can_broadcast is None:
        can_broadcast = fits_broadcast(entries)
    in_text = F.contains("hay", F.col("needle"))
    if can_broadcast:
        seen = hay.withColumn("key", F.explode(pieces))
        return seen.join(F.broadcast(entries), "key").filter(in_text)
    # a common key may occur in a large part of all texts
    seen = hay.select(row_id, F.explode(pieces).alias("key"))
    candidates = skewed_join(seen, entries, "key", row_id).drop("key")
    return candidates.join(hay, row_id).filter(in_text)


def blocklist_rows(matched: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per hit: ``row_id, pos, word, source``."""
    return matched.select(
        row_id,
        F.posexplode(F.arrays_zip("matched_words", "matched_sources")).alias("pos", "hit"),
    ).select(
        row_id,
        "pos",
        F.col("hit.matched_words").alias("word"),
        F.col("hit.matched_sources").alias("source"),
    )
