"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest. A batch is aggregated to one
row per digest, anti-joined with the index by sort-merge (the index side needs no shuffle) and what
is new is appended. Nothing but (doc_id, digest) is ever shuffled.

Defined results: a null text counts as empty; texts are equal when byte-identical; of equal texts the
row with the largest doc_id stays (a null doc_id is below every other); of rows repeated with the
same doc_id and text exactly one stays; a text that an earlier batch brought is dropped with that
batch's keep_id, even if its doc_id is larger; an empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import work

#: At most this many digests can each have one in HOT_GROUPS of a batch's rows, so their rows can be broadcast.
HOT_GROUPS = 4096

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, n BIGINT, batch INT"


def digest_of(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def table_of(path: str) -> str:
    """What the catalog calls the index at ``path``."""
    return "digests_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index among the run's working tables."""
    path = work.new_path(spark, "digest-index")
    work.own.tables[path] = table_of(path)
    return DigestIndex(spark, path)


class DigestIndex:
    """A digest table at ``path``; opened again in another session with the same path and buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 0):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = table_of(path)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        last = self.read().agg(F.max("batch")).first()[0]
        self.batches = 0 if last is None else last + 1

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> int:
        """Append the digests of ``groups`` (digest, keep_id, n) that are new; returns the batch number.

        The append is one write job, so a failed one leaves no rows behind and can be run again.
        """
        batch = self.batches
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", "n", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .insertInto(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        self.batches += 1
        return batch


def decide(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: Column | None = None, batches: int = 1) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    The rows go through the index in one batch, or in ``batches`` of them numbered by ``batch`` (from
    0): each is anti-joined with what the index holds by then, so a text that an earlier batch (of
    this call or of an earlier one) brought is dropped with that batch's keep_id. group_size counts
    the rows of a text in this call and, if it is older, in the batch that brought it.
    Groups with more than 1/HOT_GROUPS of the rows are looked up by a broadcast join (no more than
    HOT_GROUPS rows by arithmetic), all others by a sort-merge join on the digest, so no task gets
    more rows of one text than that share.
    """
    number = F.lit(0) if batch is None else batch
    rows = work.written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"), number.cast("int").alias("_batch")).withColumn("_row", F.monotonically_increasing_id()),
        "digests",
    )
    best = F.max(F.struct("doc_id", "_row"))
    groups = work.written(rows.groupBy("_batch", "digest").agg(best.alias("_best"), F.count(F.lit(1)).alias("n")).select("_batch", "digest", F.col("_best.doc_id").alias("keep_id"), F.col("_best._row").alias("_keep_row"), "n"), "groups")
    first = index.batches
    for b in range(batches):
        index.add(groups.where(F.col("_batch") == b))
    seen = index.read().select("digest", F.col("keep_id").alias("_first_id"), F.col("n").alias("_first_n"), (F.col("batch") - first).alias("_brought"))
    met = groups.join(seen.hint("merge"), "digest").groupBy("digest").agg(
        F.max("_first_id").alias("keep_id"),
        F.max(F.when(F.col("_brought") == F.col("_batch"), F.col("_keep_row"))).alias("_keep_row"),
        (F.sum("n") + F.max(F.when(F.col("_brought") < 0, F.col("_first_n")).otherwise(0))).alias("group_size"),
        F.sum("n").alias("n"),
    )
    verdicts = work.written(met, "verdicts")
    total = rows.count()
    hot = F.col("n") * HOT_GROUPS > total
    heavy = verdicts.where(hot).drop("n")
    in_heavy = rows.join(F.broadcast(heavy), "digest")
    others = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    in_others = others.join(verdicts.where(~hot).drop("n").hint("merge"), "digest")
    both = in_heavy.unionByName(in_others)
    return both.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(False)).alias("kept"), "digest")


def keep_one(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``decide`` drops, with the columns it has."""
    spark = docs.sparkSession
    index = index or new_index(spark)
    kept = decide(docs, index, id_col, text_col).where("kept").select(F.col("doc_id").alias("_k"), F.col("digest").alias("_d"))
    keyed = docs.withColumns({"_docloom_digest": digest_of(text_col)})
    found = keyed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("_k")) & (F.col("_docloom_digest") == F.col("_d")), "left_semi")
    # rows repeated with the same id and text all match; one of them stays (same keys as the join: no further shuffle)
    order = F.row_number().over(_repeats(id_col))
    return found.withColumn("_docloom_n", order).where("_docloom_n = 1").drop("_docloom_n", "_docloom_digest")


def _repeats(id_col: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(F.col(id_col), F.col("_docloom_digest")).orderBy(F.lit(1))


#: The batches in which the query brings the documents into its index.
BATCHES = 3


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents through an index: doc_id, keep_id, group_size, kept, text_sha256.

    They come in BATCHES ranges of doc_id, the largest ids first, so that of equal texts the one
    that stays is in the index already when the others come; null ids come last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = new_index(spark)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = 1 if low is None else -(-(high - low + 1) // BATCHES)
    batch = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / width), F.lit(BATCHES - 1)) if low is not None else None
    return decide(docs, index, batch=batch, batches=BATCHES).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
