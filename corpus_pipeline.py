"""A corpus made ready for training: five stages, each over what the one before kept, written and read between them.

Edge cases: each stage reads texts whole. Null and empty texts are scored by the classifier like any other, and those that it keeps
are near copies of each other. Rows with a null doc_id go through all stages; a document is what has one doc_id and text, so rows that
share the id alone stay apart. A null source is a source of its own. Columns beside doc_id, text and source pass through the first four
stages whatever their names. An empty table, or one of which a stage keeps nothing, gives no rows and no error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import decontaminate, mixing, packing, quality, simhash
from tracelode.llm.common import load, shared_dir
from tracelode.sources.shared import removed


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.drop_near_copies(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_leaked(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids, written as matrices and read back, in the order of the files and their rows: reading deals files out by size."""
    at = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return packing.packed_files(at.orderBy("__file", "__row"))


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("benchmark decontamination", unleaked), ("mixing", mixed), ("token-ID output", packed)]

#: Trained models and tokenizers aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; what each keeps is written in the shared folder, and removed when the next has read it."""
    docs = load(spark, sf_dir, "documents")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            removed(spark, f"{root}/{k - 1}")
    return docs
