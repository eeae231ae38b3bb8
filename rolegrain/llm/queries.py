"""The queries of the training-data operators, over the tables they are meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrain.llm import jaccard, langid, lmscore, media, mixing, oracles, packing, personal, secrets, substrings, topk, tries, urls, whitening


#: Shares of the tokens that the mixture is to have, by domain of the labels table.
TARGET = {"clean": 0.9, "low": 0.08, "toxic": 0.02}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixing.document_rates(docs, labels, TARGET)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (with doc_id) and pages (with page_id), under one model and one set of priors."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    return langid.judged(langid.document_rows(docs).unionByName(langid.page_rows(pages)), ["doc_id", "page_id"])


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images; each vector of embeddings is drawn as one."""
    return media.copy_groups(media.drawn(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; tests/llm holds the others against brute force."""
    return {"op2_ngram_jaccard": oracles.NGRAM_JACCARD, "op3_substring_dedup": oracles.SUBSTRING_DEDUP, "op5_exact_top_k": oracles.TOP_K, "op8_secret_scan": oracles.SECRET_SCAN, "op13_prefix_trie": oracles.PREFIX_TRIE}
