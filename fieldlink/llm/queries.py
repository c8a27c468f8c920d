"""Registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlink.llm.common import table

LLM_QUERIES: dict = {}
LLM_ORACLES: dict = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.bpe import encode_documents
    from fieldlink.llm.packing import pack_documents

    encoded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(encoded, size=2048, end_id=0)


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.bpe import round_trip_documents

    turned = round_trip_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    hashed = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return turned.select("doc_id", "n_tokens", *hashed)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.token_counts import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), budget=2048)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.pii import BASE, KINDS, find, joined

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(BASE).cast("binary"), 256).alias("base_sha256"),
        joined(tuple(k.name for k in KINDS)).alias("spans"),
    )


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.near_dup import components

    return components(table(spark, sf_dir, "documents"), words=4, percent=80)


@query
def op7_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.quality import held_out, train, with_score

    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels"), fold=(4, 2)))
    return scored.select("doc_id", held_out((4, 2)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.quality import held_out
    from fieldlink.llm.toxicity import train, with_score

    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels"), fold=(5, 0)))
    return scored.select("doc_id", held_out((5, 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


# No twin: its first stages are trained models.
LLM_QUERIES["pipeline"] = corpus_pipeline.run


@query
def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def _licence_twin() -> str:
    from fieldlink.llm.licences import oracle

    return oracle()


LLM_ORACLES["op4_licence_sentences"] = _licence_twin()


@query
def op13_rank_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.rank_bpe import round_trip_ranked

    turned = round_trip_ranked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return turned.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlink.llm.repair import repair_damaged

    return repair_damaged(table(spark, sf_dir, "conversations"))
