"""The index on disk: chunks and documents in hash buckets of Parquet files behind numbered pointer files.

A write makes new files for the buckets it touches, of both tables where both change, and then
renames one pointer file into place: readers see the old state or the new one, a write that fails
leaves no trace that is read, and of two writers at once one gets an error. What a pointer no longer
names is deleted by the write after the next, so readers of the state before can finish.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.errors import StorageError
from docloom.functions import text as tx
from docloom.functions.vectors import checked_vector
from docloom.operators.search import postings, text_index
from docloom.schemas import CHUNKS, DOCUMENTS
from docloom.staging import file_system, library


def with_defaults(chunks: DataFrame, dim: int = 1024) -> DataFrame:
    """Chunks in the index's schema: word counts anew, General and no entities as defaults, zeros for a missing vector.

    A vector of another length than ``dim`` is an error.
    """
    have = set(chunks.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return chunks.select(
        F.xxhash64("source_doc_id", F.col("chunk_index").cast("int")).alias("id"),
        "text",
        F.coalesce(checked_vector(col("embedding", "array<float>").cast("array<float>"), dim), zeros).alias("embedding"),
        "source_doc_id",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.coalesce(col("section_path", "array<string>"), F.array(F.lit("General"))).alias("section_path"),
        tx.count_words(F.col("text")).cast("int").alias("word_count"),
        F.coalesce(col("entity_names", "array<string>"), F.array().cast("array<string>")).alias("entity_names"),
    )


def one_of_each(rows: DataFrame, *key: str) -> DataFrame:
    """One row of every key, the one of the largest text where a batch repeats a key."""
    text = "text" if "text" in rows.columns else "text_summary"
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(text)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def merge(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``new`` over ``old`` by key; of repeated keys in ``new`` one row counts."""
    return old.join(new.select(*key).distinct(), [*key], "left_anti").unionByName(one_of_each(new, *key))


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks of every document in ``new`` instead of those in ``old``: no stale tail stays."""
    kept = old.join(new.select("source_doc_id").distinct(), "source_doc_id", "left_anti")
    return kept.unionByName(one_of_each(new, "source_doc_id", "chunk_index"))


#: Each table's schema and the column that deals its rows to buckets.
TABLES = {"chunks": (CHUNKS, "source_doc_id"), "documents": (DOCUMENTS, "source_file")}


class Index:
    """An index folder (any file system that Spark writes to).

    ``buckets`` counts when the index is made: an upsert rewrites the buckets that its rows fall
    into, so a large index that gets small batches should have many.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int = 1024, buckets: int = 64):
        self.spark, self.path, self.dim, self.buckets = spark, path.rstrip("/"), dim, buckets

    # -- versions

    def _pointers(self) -> list[str]:
        """The pointer files, oldest first."""
        fs, path = file_system(self.spark, self.path)
        at = path(f"{self.path}/pointers")
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _state(self) -> dict:
        """number, buckets, tables (name to bucket to version folder) and the folders that are no longer named."""
        names = self._pointers()
        if not names:
            return {"number": 0, "buckets": self.buckets, "tables": {name: {} for name in TABLES}, "stale": []}
        fs, path = file_system(self.spark, self.path)
        stream = fs.open(path(f"{self.path}/pointers/{names[-1]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise StorageError(f"{self.path}/pointers/{names[-1]} is damaged") from e

    def _bucket(self, name: str, state: dict):
        return F.pmod(F.xxhash64(TABLES[name][1]), F.lit(state["buckets"]))

    def _read(self, name: str, state: dict, only: list[int] | None = None) -> DataFrame:
        held = state["tables"][name]
        paths = [f"{self.path}/{version}/_b={b}" for b, version in held.items() if only is None or int(b) in only]
        schema = TABLES[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, changes: dict) -> None:
        """Write ``changes``, (table, bucket numbers, function of its old rows in them to new ones), and move the pointer."""
        state = self._state()
        fs, path = file_system(self.spark, self.path)
        gone: list[str] = []
        for name, (touched, change) in changes.items():
            if not touched:
                continue
            key = TABLES[name][1]
            version = f"{name}-{uuid.uuid4().hex}"
            rows = change(self._read(name, state, touched)).withColumn("_b", self._bucket(name, state))
            # ranges, not hashes, of (bucket, key): a large bucket is several files, a small one is one
            rows.repartitionByRange("_b", key).sortWithinPartitions("_b", key).write.partitionBy("_b").parquet(f"{self.path}/{version}")
            made = {x.getPath().getName()[3:] for x in fs.listStatus(path(f"{self.path}/{version}")) if x.isDirectory()}
            held = state["tables"][name]
            gone += [f"{held[str(b)]}/_b={b}" for b in touched if str(b) in held]
            state["tables"][name] = {b: v for b, v in held.items() if int(b) not in touched} | {b: version for b in made}
        before = state["stale"]
        state |= {"number": state["number"] + 1, "stale": gone}
        fs.mkdirs(path(f"{self.path}/pointers"))
        temporary, final = f"{self.path}/pointers/.{uuid.uuid4().hex}", f"{self.path}/pointers/{state['number']:012d}.json"
        out = fs.create(path(temporary), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(path(final)) or not fs.rename(path(temporary), path(final)):
            fs.delete(path(temporary), False)
            raise StorageError(f"{self.path} was changed by another writer")
        for old in before:
            fs.delete(path(f"{self.path}/{old}"), True)
        for old in self._pointers()[:-2]:
            fs.delete(path(f"{self.path}/pointers/{old}"), False)

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``: no more numbers than the index has buckets."""
        return [r[0] for r in rows.select(self._bucket(name, self._state()).alias("b")).distinct().collect()]

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks", self._state())

    @property
    def documents(self) -> DataFrame:
        return self._read("documents", self._state())

    def postings(self) -> DataFrame:
        """The inverted index, always derived from the chunks."""
        return postings(text_index(self.chunks))

    # -- writing

    def _new_chunks(self, chunks: DataFrame) -> DataFrame:
        return library.written(with_defaults(chunks, self.dim), "new-chunks")

    def _new_documents(self, documents: DataFrame) -> DataFrame:
        have = set(documents.columns)
        vector = F.col("embedding").cast("array<float>") if "embedding" in have else F.lit(None).cast("array<float>")
        new = documents.select(
            F.xxhash64("source_file").alias("id"),
            "title",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags") if "tags" in have else F.array().cast("array<string>").alias("tags"),
            F.substring("text_summary", 1, 1000).alias("text_summary"),
            "source_file",
            (F.col("total_chunks") if "total_chunks" in have else F.lit(0)).cast("int").alias("total_chunks"),
            F.when(F.size(vector) > 0, checked_vector(vector, self.dim)).alias("embedding"),
            F.current_timestamp().alias("created_at"),
        )
        return library.written(new, "new-documents")

    def upsert_chunk(self, chunks: DataFrame) -> None:
        """Insert or update single chunks by (source_doc_id, chunk_index); other chunks stay."""
        new = self._new_chunks(chunks)
        self._commit({"chunks": (self._touched("chunks", new), lambda old: merge(old, new, "source_doc_id", "chunk_index"))})

    def upsert_chunks(self, chunks: DataFrame) -> None:
        """Replace the chunks of all documents in ``chunks``; an empty table changes nothing."""
        new = self._new_chunks(chunks)
        self._commit({"chunks": (self._touched("chunks", new), lambda old: replace_documents(old, new))})

    def upsert_documents(self, documents: DataFrame) -> None:
        """Insert or update documents by source_file; summaries are cut to 1000 characters, empty vectors are null."""
        new = self._new_documents(documents)
        self._commit({"documents": (self._touched("documents", new), lambda old: merge(old, new, "source_file"))})

    def replace(self, chunks: DataFrame, documents: DataFrame) -> None:
        """``upsert_chunks`` and ``upsert_documents`` in one step: readers see both or neither."""
        pieces, rows = self._new_chunks(chunks), self._new_documents(documents)
        self._commit({
            "chunks": (self._touched("chunks", pieces), lambda old: replace_documents(old, pieces)),
            "documents": (self._touched("documents", rows), lambda old: merge(old, rows, "source_file")),
        })

    def _delete(self, name: str, column: str, value: str) -> int:
        mine = F.col(column).eqNullSafe(F.lit(value))
        at = self._touched(name, self.spark.range(1).select(F.lit(value).alias(column)))
        gone = self._read(name, self._state(), at).where(mine).count()
        if gone:
            self._commit({name: (at, lambda old: old.where(~mine))})
        return gone

    def delete_chunks(self, doc_id: str) -> int:
        """Delete a document's chunks; how many there were."""
        return self._delete("chunks", "source_doc_id", doc_id)

    def delete_document(self, source_file: str) -> bool:
        """Delete a document's row; whether there was one."""
        return self._delete("documents", "source_file", source_file) > 0

    # -- reading

    def chunks_of(self, doc_id: str) -> DataFrame:
        """A document's chunks in order; an empty section path reads as General."""
        state = self._state()
        at = self._touched("chunks", self.spark.range(1).select(F.lit(doc_id).alias("source_doc_id")))
        path = F.when(F.coalesce(F.size("section_path"), F.lit(0)) <= 0, F.array(F.lit("General"))).otherwise(F.col("section_path"))
        return self._read("chunks", state, at).where(F.col("source_doc_id") == doc_id).withColumn("section_path", path).orderBy("chunk_index")

    def with_entity(self, name: str) -> DataFrame:
        """The chunks that name an entity."""
        return self._read("chunks", self._state()).where(F.array_contains("entity_names", name))
