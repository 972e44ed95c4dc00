"""The corpus pipeline: documents to a filtered, deduplicated, mixed and encoded training set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import stages
from docloom.staging import shared_dir, spread

STAGES = [
    ("quality classifier", stages.good_quality),
    ("exact dedup", stages.one_of_equal),
    ("n-gram Jaccard join", stages.one_of_near),
    ("mixing sources to target weights", stages.mixed),
    ("SentencePiece encoding and decoding", stages.encoded),
]

#: The classifier, the rounding and the encoding can't be expressed in SQL: tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        # not among the working tables, which the next stage deletes
        path = f"{shared_dir(spark)}/docloom/stage-{name.split()[0].lower()}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
