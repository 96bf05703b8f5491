"""From raw documents to token ids: STAGES in order, each a function of (spark, docs, sf_dir) that returns a
DataFrame. All but the last return the rows of ``docs`` that they keep, with its columns.

The first two stages decide on each row by its text, the next two by its doc_id, which is expected to be
unique; rows that repeat one go together (near-duplicate removal keeps those of each group's smallest id). Null and empty texts have no
letter and so go with language identification. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import bpe, decontaminate, language_id, near_dedup, toxicity
from plinth.llm.common import few, stored, table
from plinth.llm.queries import tokenizer


def _without(docs: DataFrame, decided: DataFrame, drop: str) -> DataFrame:
    """The rows of ``docs`` but those whose id ``decided`` drops."""
    ids = stored(decided.where(drop).select(F.col("doc_id").alias("_dropped")).distinct())
    return docs.join(few(ids), F.col("doc_id") == F.col("_dropped"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = toxicity.scorer(spark, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < 0.5)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predict = language_id.predictor(spark, language_id.train(docs))
    return docs.where(~predict(F.col("text"))["rejected"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_dedup.near_duplicates(docs), "not kept")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found, "contaminated")


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ``ids`` binary, little-endian unsigned 32-bit."""
    trip = bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"))
    return trip.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_bytes),
]

#: SQL can't train the classifiers or merge pairs by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
