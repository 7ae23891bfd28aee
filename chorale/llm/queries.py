"""Registered queries of this subpackage and the SQL they are checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import oracles
from chorale.llm.common import crc_class, settings, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, root: str) -> DataFrame:
        settings(spark)
        return build(spark, root)

    LLM_QUERIES[build.__name__] = run
    return build


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.substrings import dedup_substrings

    return dedup_substrings(table(spark, root, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op2_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.packing import pack

    return pack(table(spark, root, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


@query
def op3_html_extraction(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.pages import extract

    return extract(table(spark, root, "pages", "page_id", "url", "html"))


@query
def op4_exact_topk(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.topk import top_products

    vectors = table(spark, root, "embeddings", "vec_id", "embedding")
    return top_products(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op5_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.pieces import round_trip

    return round_trip(table(spark, root, "documents", "doc_id", "text"), vocabulary("piece_bpe_32k.model"))


@query
def op6_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.quality import fit, score

    docs, held = table(spark, root, "documents", "doc_id", "text"), crc_class("doc_id", 3) == 1
    model = fit(docs, table(spark, root, "labels", "doc_id", "quality"), ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op7_simhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.simhash import cluster

    found = cluster(table(spark, root, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_embedding_dedup(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.vectors import near_duplicates

    return near_duplicates(table(spark, root, "embeddings", "vec_id", "embedding", "label"))


@query
def op9_toxicity(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.toxicity import fit, score

    docs, held = table(spark, root, "documents", "doc_id", "text"), crc_class("doc_id", 5) == 0
    model = fit(docs, table(spark, root, "labels", "doc_id", "toxic"), ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op10_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.suffixes import dedup_suffixes

    return dedup_suffixes(table(spark, root, "documents", "doc_id", "text"))


@query
def op11_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.prefixes import trie

    return trie(table(spark, root, "conversations", "conv_id", "turn", "role", "text"))


@query
def op12_document_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.fingerprints import compare

    return compare(table(spark, root, "documents", "doc_id", "text"))


@query
def op13_filter_audit(spark: SparkSession, root: str) -> DataFrame:
    from chorale.llm.audit import audit

    return audit(table(spark, root, "documents", "doc_id", "text", "source"), table(spark, root, "labels", "doc_id", "quality", "toxic"))


LLM_ORACLES = oracles.SQL
