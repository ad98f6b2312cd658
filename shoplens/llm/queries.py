"""Registered queries of the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shoplens.llm import (bpe, exact_dedup, jaccard, kd_shards, langid, lexical, packing, pii, prefix_trie,
                          repeats, token_file, topk, toxicity as toxic)
from shoplens.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by merge replay, and their way back to bytes."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@_query("op2_exact_dedup", exact_dedup.SQL)
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document."""
    return exact_dedup.keepers(_table(spark, sf_dir, "documents"))


@_query("op3_token_file")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token file, read back from the file."""
    path = work_dir(spark, "token-file")
    token_file.write(_table(spark, sf_dir, "documents"), path,
                     public_tokenizers.path("word_bpe_49k.json"))
    return token_file.read_documents(spark, path)


@_query("op4_ngram_jaccard", jaccard.SQL)
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of similar shingle sets."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op5_best_fit_packing")
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


@_query("op6_suffix_dedup", repeats.SQL)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 50 bytes that a smaller document has."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


@_query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxic.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op8_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(_table(spark, sf_dir, "documents"))


@_query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query("op10_exact_topk", topk.SQL)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


@_query("op11_lexical_search", lexical.SQL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op12_prefix_trie", prefix_trie.SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


@_query("op13_kd_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return kd_shards.report(_table(spark, sf_dir, "documents"))
