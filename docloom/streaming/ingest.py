"""Continuous ingest: a stream of documents into an index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docloom.config import Config
from docloom.plans.ingest import build_index
from docloom.plans.store import Index
from docloom.staging import library

DOCUMENT_STREAM = "doc_id string, source_file string, text string"


def stream_documents(spark: SparkSession, folder: str, schema: str = DOCUMENT_STREAM, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_stream(docs: DataFrame, index: Index, checkpoint: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    """Upsert every micro-batch into the index; a batch that is run again replaces its own rows.

    Of a document that a batch holds several times the last row (by text) counts. With ``once`` what
    is there is taken and the query ends.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        latest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("text")))
        rows = batch.withColumn("_n", latest).where("_n = 1").drop("_n")
        index.replace(*build_index(rows, config))
        library.release(rows.sparkSession)

    writer = docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
