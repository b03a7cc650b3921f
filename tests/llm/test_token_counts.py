from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from utterance_guard.llm import token_counts
from utterance_guard.llm.token_counts import JsonCounter, TokenizerFile, count_tokens, pieces

SCHEMA = "doc_id long, text string, digest int, n_tokens string, content int"
BYTES = TokenizerFile.read(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return JsonCounter(BYTES.data)


def own(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def run(spark, rows, cache, tokenizer=BYTES, **how):
    docs = spark.createDataFrame([(i, t, 1, "y", 2) for i, t in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, count_tokens(docs, tokenizer, str(cache), **how).collect()), key=str)


def cached(spark, cache, tokenizer=BYTES):
    return spark.read.parquet(f"{cache}/{tokenizer.version}")


PARTS = st.sampled_from(
    ["a", "Ab", " ", "  ", "\n", "\t", "'s", "'", "it's", "ü", "é", "é", "12", "٣", "漢字", "😀",
     "<|endoftext|>", "<|", "|>", " ", "\x85", "\x1c", " ", "…", "€", "—", "ы", "!?", "Ω",
     "ʼn", "​", "ﬁ", "\x00", "\x7f", "͸", "ͅ", "  x", "x  ", " <|endoftext|> "]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_counts_are_the_library_s(library, counter, text):
    assert counter([text]) == [own(library, text)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, counter, text):
    assert counter([text]) == [own(library, text)]


def test_long_texts_are_cut_where_no_token_spans(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 40)
    text = "The quick  brown fox's 12 <|endoftext|> jumps,\n\nover über 3 dogs <|endoftext|>" * 9
    assert len(list(pieces(text))) > 5 and "".join(pieces(text)) == text
    assert counter([text, "x" * 200, " " * 200]) == [
        own(library, t) for t in (text, "x" * 200, " " * 200)
    ]


def test_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 5)
    small = JsonCounter(BYTES.data)
    texts = [f"word{i} other{i} thing{i}" for i in range(30)] * 2
    assert small(texts) == [own(library, t) for t in texts]
    assert len(small.memo) < 5 + 10


def test_table(spark, library, tmp_path):
    long = "wörter und <|endoftext|> mehr, " * 30_000
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "Hello world"), (4, long), (4, "x")]
    rows += [(i, "hot text, many times") for i in range(100, 400)]
    found = run(spark, rows, tmp_path)
    wanted = [(i, len((t or "").encode()), own(library, t)) for i, t in rows]
    assert found == sorted(((*w, w[2] > 512) for w in wanted), key=str)
    assert cached(spark, tmp_path).count() == 5  # one row a distinct text


def test_hits_come_from_the_cache(spark, library, tmp_path):
    rows = [(1, "one"), (2, "two words"), (3, "three words here")]
    run(spark, rows, tmp_path)
    files = set(cached(spark, tmp_path).inputFiles())
    assert run(spark, rows, tmp_path) == run(spark, rows, tmp_path)
    assert set(cached(spark, tmp_path).inputFiles()) == files  # nothing was encoded again
    # what is stored is the answer, so a marked count shows that it was read
    marked = cached(spark, tmp_path).withColumn("n_tokens", F.lit(-7).cast("long"))
    marked.write.parquet(f"{tmp_path}/other/{BYTES.version}")
    found = run(spark, [*rows, (4, "a fourth text")], f"{tmp_path}/other")
    assert [r[2] for r in found] == [-7, -7, -7, own(library, "a fourth text")]
    assert cached(spark, f"{tmp_path}/other").count() == 4


@pytest.mark.parametrize("small", [True, False])
def test_broadcast_or_dealt(spark, library, tmp_path, monkeypatch, small):
    monkeypatch.setattr(token_counts, "fits_broadcast", lambda df: small)
    run(spark, [(i, f"old {i % 5}") for i in range(20)], tmp_path)
    rows = [(i, f"old {i % 5}") for i in range(20)] + [(i, f"new {i % 7}") for i in range(40)]
    found = run(spark, rows, tmp_path)
    assert sorted(r[2] for r in found) == sorted(own(library, t) for _, t in rows)
    assert cached(spark, tmp_path).count() == 12


def test_two_writers_at_once(spark, library, tmp_path):
    rows = [(1, "said twice"), (2, "and once")]
    run(spark, rows, tmp_path)
    cached(spark, tmp_path).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{BYTES.version}")
    assert cached(spark, tmp_path).count() == 4
    assert len(run(spark, rows, tmp_path)) == 2


def test_versions_do_not_mix(spark, tmp_path):
    words = TokenizerFile.read(public_tokenizers.path("word_bpe_49k.json"))
    pieces_ = TokenizerFile.read(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(1, "Some  TEXT, with <|endoftext|> tokens"), (2, "ünïcode 漢字"), (3, None)]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    by_bytes = run(spark, rows, tmp_path)
    by_words = run(spark, rows, tmp_path, words)
    by_pieces = run(spark, rows, tmp_path, pieces_)
    assert [r[2] for r in by_words] == [own(library, t) for _, t in rows]
    assert [r[2] for r in by_pieces] == [len(model.encode(t or "")) for _, t in rows]
    assert run(spark, rows, tmp_path) == by_bytes
    assert len({BYTES.version, words.version, pieces_.version}) == 3


def test_normal_form_is_counted(spark, library, tmp_path):
    rows = [(1, "Loud TEXT"), (2, "loud text")]
    found = run(spark, rows, tmp_path, normal=F.lower)
    assert [r[2] for r in found] == [own(library, "loud text")] * 2
    assert cached(spark, tmp_path).count() == 1


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
