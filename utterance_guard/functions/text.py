"""Column functions on text. All of them run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The blanks that Python's str.strip removes.
BLANKS = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The eight marks that speech recognition never emits.
PUNCTUATION = "、。！？,.!?"

# The words of the browser's keyword check, in their order, repeats included.
KEYWORDS = (
    "年収", "結婚", "彼女", "彼氏", "病気", "障害", "低学歴", "デブ", "チビ", "ハゲ",
    "キモい", "キチガイ", "ブス", "ババア", "ジジイ", "ブタ", "アホ", "クズ", "バカ", "カス",
    "ゴミ", "クソ", "死ね", "消えろ", "殺す", "ブサイク", "おばさん", "ババア", "キモ", "目障り",
    "使えない", "無能", "無駄", "無価値", "無意味", "お前", "病気", "障害", "低学歴", "デブ",
    "チビ", "ハゲ", "キモい", "キチガイ", "ブス", "ババア", "ジジイ", "ブタ", "責任", "甘え",
)

# Names of the classes, by class id.
LABELS = ("該当なし", "ハラスメント・侮辱")
NONE_LABEL, HARASSMENT_LABEL = LABELS

# The confidence band that a person should look at, both ends included.
REVIEW_LOW, REVIEW_HIGH = 0.55, 0.70

# Fixed value: length limit of the text model, in tokens.
MAX_TOKENS = 512

WORD = r"\p{L}+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Drop Unicode blanks at both ends. ``btrim`` takes a set of characters and stays in
    generated code; the same rule as a regular expression is some twenty times slower."""
    return F.btrim(_col(text), F.lit(BLANKS))


def is_ascii(text: Column | str) -> Column:
    text = _col(text)
    return F.octet_length(text) == F.char_length(text)


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility composition.

    Spark has no function for it, but ships the ICU library and can call a static method.
    Pure ASCII text (as many bytes as characters) never gets there.
    """
    text = _col(text)
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )
    return F.when(F.octet_length(text) > F.char_length(text), composed).otherwise(text)


def normalize(text: Column | str) -> Column:
    """NFKC, then lower case."""
    return F.lower(nfkc(text))


@F.pandas_udf(T.StringType())
def normalize_arrow(text: pd.Series) -> pd.Series:
    """The same rule through Arrow, for clusters that forbid ``reflect``."""
    return text.map(
        lambda t: unicodedata.normalize("NFKC", t).lower(), na_action="ignore"
    )


def strip_punctuation(text: Column | str) -> Column:
    return strip(F.translate(_col(text), PUNCTUATION, ""))


def keyword_hit(text: Column | str, words: list[str] | tuple[str, ...] = KEYWORDS) -> Column:
    """True where any word occurs in the raw text: case counts, nothing is normalised."""
    text = _col(text)
    distinct = list(dict.fromkeys(words))
    if not distinct:
        return F.lit(False)
    return F.exists(F.array(*map(F.lit, distinct)), lambda w: F.contains(text, w))


def tokens(text: Column | str, kind: str = "word") -> Column:
    """Tokens of already normalised text: ``word`` for spaced scripts, ``bigram`` (pairs of
    characters, blanks left out) for Japanese. A one-character text is its own token."""
    text = F.coalesce(_col(text), F.lit(""))
    if kind == "word":
        return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if kind == "bigram":
        packed = F.regexp_replace(text, r"\s+", "")
        pairs = F.regexp_extract_all(packed, F.lit(r"(?s)(?=(..))."), F.lit(1))
        return F.when(F.char_length(packed) == 1, F.array(packed)).otherwise(pairs)
    raise ValueError(f"unknown kind of token: {kind}")


def truncate_tokens(
    toks: Column | str, max_len: int = MAX_TOKENS, special: tuple[str, str] = ("[CLS]", "[SEP]")
) -> Column:
    """Model input of at most ``max_len`` tokens, the two special ones included."""
    if max_len < 2:
        raise ValueError("max_len must leave room for the two special tokens")
    first, last = special
    return F.concat(
        F.array(F.lit(first)), F.slice(_col(toks), 1, max_len - 2), F.array(F.lit(last))
    )


def phrase_form(text: Column | str) -> Column:
    """Lower-case tokens between single blanks, so that a phrase is found by ``contains``."""
    return F.concat(
        F.lit(" "), F.btrim(F.regexp_replace(F.lower(_col(text)), NOT_WORD, " ")), F.lit(" ")
    )


def blocklist_reason(sources: Column | str) -> Column:
    return F.concat(F.lit("blocklist("), F.array_join(_col(sources), ","), F.lit(")"))


def needs_review(
    confidence: Column | str, low: float = REVIEW_LOW, high: float = REVIEW_HIGH
) -> Column:
    """Ask before rounding: 0.70004 is outside although it prints as 0.7."""
    return _col(confidence).between(low, high)


def round4(value: Column | str) -> Column:
    """Four digits, half up on the printed decimal. Python rounds the binary value, so the
    two differ on printed ties only (2.67455 gives 2.6746 here, 2.6745 there)."""
    return F.round(_col(value), 4)


def text_key(text: Column | str) -> Column:
    """A 32-byte stand-in for exact equality of texts: shuffles carry it, not the text."""
    return F.unhex(F.sha2(_col(text), 256))


def seeded_hash(seed: int, *parts: Column | str) -> Column:
    """``md5('seed:part:...')`` as 32 hex digits, alike on every engine and every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(p).cast("string") for p in parts]))


def hash_percent(hexdigest: Column) -> Column:
    """Map a digest to 0..99.9999 by its first eight digits (exact in a long)."""
    return (F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("long") * 100) / F.lit(2**32)
