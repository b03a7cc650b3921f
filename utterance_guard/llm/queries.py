"""The queries of this package: each operator over its whole table, with the production
parameters that its module states."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from utterance_guard.llm.common import table
from utterance_guard.llm.decontaminate import find_leaks
from utterance_guard.llm.exact_dedup import exact_dedup
from utterance_guard.llm.lexical import build_index as build_lexical_index
from utterance_guard.llm.lexical import search
from utterance_guard.llm.middle import digests_of
from utterance_guard.llm.mixing import mix_sources, taken_words
from utterance_guard.llm.quality import classify
from utterance_guard.llm.repeats import remove_repeats
from utterance_guard.llm.secrets import find_secrets
from utterance_guard.llm.simhash import hex_print, near_groups
from utterance_guard.llm.suffix_tree import fit, score_texts
from utterance_guard.llm.token_counts import TokenizerFile, count_tokens, fresh_cache
from utterance_guard.llm.url_filter import build_index, filter_urls, unwanted_hosts
from utterance_guard.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(mix_sources(table(spark, folder, "documents")))


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return filter_urls(pages, build_index(unwanted_hosts(pages))).drop("listed")


@query
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents")).select(
        "doc_id", hex_print().alias("fingerprint"), "component_id"
    )


@query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_texts(docs, fit(docs))


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return digests_of(table(spark, folder, "documents"))


@query
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = TokenizerFile.read(public_tokenizers.path("byte_bpe_50k.json"))
    return count_tokens(table(spark, folder, "documents"), tokenizer, fresh_cache(spark))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = build_lexical_index(table(spark, folder, "documents"))
    return search(index, table(spark, folder, "benchmark"))
