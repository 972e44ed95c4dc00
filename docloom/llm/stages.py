"""The stages of the corpus pipeline as functions of (spark, docs, sf_dir).

``docs`` is a written table; each stage first deletes the working tables of the one before.

Defined results, of every stage: columns that aren't named here stay as they are, whatever they are
called; an empty table gives an empty one; a null text counts as an empty one, and very long texts
are treated whole.

- good_quality: empty texts are scored like others; documents of a null id are scored, but teach nothing.
- one_of_equal: of rows that are equal in text and doc_id one stays; a null id is below every other.
- one_of_near: texts without words all stay; of a component one row stays, even where ids repeat.
- mixed: texts without words and rows of sources without words are taken as often as their source's
  rate says, rounded down; rows that are equal in all columns share their copies; ties of size are
  broken by a hash of the row.
- encoded: a null text has no ids and 0 bytes and is lossless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_codec, work


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labels of ``sf_dir``, predicts to be good."""
    work.release(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model).select(*docs.columns)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id."""
    work.release(spark)
    return exact_dedup.keep_one(docs).select(*docs.columns)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (5 words, Jaccard 0.8), that of the smallest doc_id."""
    work.release(spark)
    return ngram_join.keep_one(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it (0 to 2), numbered by ``copy``."""
    work.release(spark)
    comparable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumn("_docloom_key", F.xxhash64(*comparable))
    due = mixing.mix(keyed, id_col="_docloom_key").groupBy("doc_id").agg(F.sum("copies").alias("_c"), F.count(F.lit(1)).alias("_n"))
    due = work.written(due.where("_c > 0").select(F.col("doc_id").alias("_docloom_key"), "_c", "_n"), "copies")
    once = keyed.join(due.where("_n = 1"), "_docloom_key")
    # equal rows: one of them stands for all, with all their copies
    shared = keyed.join(due.where("_n > 1"), "_docloom_key").dropDuplicates(["_docloom_key"])
    rows = once.unionByName(shared).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
    return rows.select(*[f"`{c}`" for c in docs.columns if c != "copy"], F.col("_copy").alias("copy"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes, lossless of every row; each ``copy`` draws its own dropout."""
    work.release(spark)
    return sentencepiece_codec.encode_documents(docs, copy_col="copy" if "copy" in docs.columns else None)
