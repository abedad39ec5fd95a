"""Documents to token files in five stages, each on all that the one before kept.

Every stage but the last returns the columns of its input, whatever they are;
only ``doc_id``, ``text`` and ``source`` are read. Empty input stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, mixing, overlap, quality, tokens
from logloom.llm.common import text_key
from logloom.session import shared_folder, staged

#: What a user may exchange: the vocabulary file.
TOKENIZER = "word_bpe_49k.json"
#: What tells rows apart.
ROW = ["doc_id", "_row_text"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts; labels come from ``labels``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that with the smallest id, null last; see ``overlap.distinct``."""
    return overlap.distinct(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item."""
    hit = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
    hit = staged(hit.select("doc_id", F.col("_text").alias("_row_text")).distinct())
    marked = docs.select(F.struct("*").alias("row"), "doc_id", text_key(F.col("text")).alias("_row_text"))
    return decontaminate.same(marked, hit, ROW, "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out whole documents, so that sources come near their targets.

    A row is written as often as the mix takes it; a part counts from half a text on.
    """
    return mixing.repeated(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write all texts as token files and return what they hold of each document."""
    return tokens.tokenized(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", good),
    ("simhash_near_dedup", distinct),
    ("benchmark_decontamination", uncontaminated),
    ("mixing_sources", mixed),
    ("token_id_output", tokenized),
]
#: Models, fingerprints and token files cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
