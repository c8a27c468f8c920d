"""The corpus pipeline: quality, toxicity, near copies, personal data, packing.

Every stage takes all documents its predecessor kept and, but for the last, gives
rows with the columns of ``documents``.  Null texts count as empty; extra columns
are carried; repeated rows stay repeated except in the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlink.lineage import cut
from fieldlink.llm import near_dup, packing, pii, quality, toxicity
from fieldlink.llm.bpe import encode_documents
from fieldlink.llm.common import table

#: Documents below this quality, or from this toxicity on, go.
LEAST_QUALITY, TOXIC = 0.5, 0.5
_SCORE = "_fieldlink_score"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold=(4, 2))
    return quality.with_score(docs, model, _SCORE).filter(F.col(_SCORE) >= LEAST_QUALITY).drop(_SCORE)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold=(5, 0))
    return toxicity.with_score(docs, model, _SCORE).filter(F.col(_SCORE) < TOXIC).drop(_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs, words=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(pii.find(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean.select(*(f"`{c}`" for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")), size=2048, end_id=0)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Trained models, tokens and best-fit order are beyond SQL; tests/llm/ holds the operators behind the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
