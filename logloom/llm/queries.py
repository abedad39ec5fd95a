"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, licenses, mixing, negatives, pivots, quality, ranked, secrets, simhash, tokens, topk, toxicity, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark, folder):
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def op2_quality(spark, folder):
    docs = _table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, folder, "labels")))


def op3_licenses(spark, folder):
    return licenses.scan(_table(spark, folder, "documents"))


def op4_topk(spark, folder):
    return topk.top_k(_table(spark, folder, "embeddings"))


def op5_warc(spark, folder):
    return warc.archive(_table(spark, folder, "pages")).drop("url")


def op6_secrets(spark, folder):
    return secrets.scan(_table(spark, folder, "documents"))


def op7_decontaminate(spark, folder):
    return decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("_text")


def op8_tokens(spark, folder):
    return tokens.tokenized(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op10_mixing(spark, folder):
    return mixing.mix(_table(spark, folder, "documents")).drop("whole", "copies", "source")


def op11_pivots(spark, folder):
    return pivots.near_duplicates(_table(spark, folder, "embeddings"))


def op12_negatives(spark, folder):
    rows = _table(spark, folder, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", shifted))


def op13_ranked(spark, folder):
    return ranked.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_licenses, op4_topk, op5_warc, op6_secrets, op7_decontaminate, op8_tokens, op9_simhash, op10_mixing, op11_pivots, op12_negatives, op13_ranked)}
