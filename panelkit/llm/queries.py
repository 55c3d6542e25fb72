"""The registered queries of the operators: ``QUERIES[name](spark, sf_dir)`` and, where SQL can tell the result, ``ORACLE[name]``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import ann, bpe, importance, lm, minhash, packing, periodic, quality, rpforest, secrets, substring, toxicity, urls
from panelkit.llm.common import table
from panelkit.llm.oracles import ORACLE  # noqa: F401

#: names in the folder of public tokenizers: a vocabulary, the same one as ranks, its special token
VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", (("<|endoftext|>", 50256),)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


@query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (minhash.near_copies(table(spark, sf_dir, "documents"))
            .withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True))))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path(RANKS), SPECIAL, public_tokenizers.path(VOCABULARY)))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query
def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_copies(table(spark, sf_dir, "embeddings"))


@query
def op7_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return ann.search(rows, rows.where("id % 20 = 0"))


@query
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4) + F.lit(0.0))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))
