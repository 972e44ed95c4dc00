"""Answers to a table of questions: search, re-rank, assemble the context, ask a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import Config
from docloom.operators.embedding import Embedder, embed_column, embed_questions
from docloom.operators.formatting import Model
from docloom.operators.search import hybrid_search, mmr_rerank, vector_search_many
from docloom.shipping import ship
from docloom.staging import library

NOTHING = "No matching documents found in the index."
ANSWER_PROMPT = "Answer the question from the given context only. If the context is not enough, say so; make nothing up."
RULE = "\n\n---\n\n"


def assemble_context(hits: DataFrame) -> DataFrame:
    """query_id, context, sources, n_chunks of ranked chunks (query_id, rank, source_doc_id, section_path, word_count, text)."""
    shown = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit(" (source: "), F.col("source_doc_id"), F.lit(", section: "), F.array_join("section_path", "/"), F.lit(", words: "), F.col("word_count").cast("string"), F.lit(")]\n"), F.col("text"))
    parts = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("t")))).alias("p"), F.array_sort(F.collect_set("source_doc_id")).alias("sources"), F.count(F.lit(1)).cast("int").alias("n_chunks"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["t"]), RULE).alias("context"), "sources", "n_chunks")


def extractive(system: str, prompt: str) -> str:
    """A stand-in for a model: the first sentence of the context."""
    _, _, context = prompt.partition("\n\nContext:\n")
    text = context.partition("]\n")[2] or context
    return text.strip().split(". ")[0].strip()[:400]


def with_vectors(candidates: DataFrame, config: Config, embedder: Callable[[], Embedder] | None) -> DataFrame:
    """Candidates with an embedding of their text where they have none, or zeros only."""
    blank = ~F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    lacking = candidates.where(blank).select(F.col("text").alias("_t")).distinct()
    made = embed_column(lacking, "_t", "_made", config, embedder)
    filled = candidates.join(made, F.col("text") == F.col("_t"), "left")
    return filled.withColumn("embedding", F.when(blank, F.coalesce("_made", "embedding")).otherwise(F.col("embedding"))).drop("_t", "_made")


def answer(questions: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 5, fetch_k: int | None = None, config: Config | None = None, model: Callable[[], Model] | None = None, embedder: Callable[[], Embedder] | None = None, mode: str = "vector_anchored") -> DataFrame:
    """query_id, question, answer, context, sources for questions (query_id, question).

    ``fetch_k`` candidates are searched and k of them kept by re-ranking (with fetch_k = k only
    their order changes). With fewer than k chunks the nearest document's summary is added.
    Without a model the answer is extractive. Questions are embedded and searched once, and so are
    candidates without a vector before re-ranking.
    """
    config = config or Config(embedding_mode="hash")
    ship(questions.sparkSession)
    asked = library.written(embed_questions(questions.select("query_id", "question"), config, embedder), "asked")
    hits = hybrid_search(chunks, asked, fetch_k or k, config.rrf_k, mode)
    hits = library.written(hits.select("query_id", "id", "rank"), "hits")
    full = hits.join(chunks, "id").join(questions.select("query_id", "question"), "query_id")
    full = with_vectors(full, config, embedder)
    ranked = mmr_rerank(full.select("query_id", "question", "id", "text", "embedding", "rank"), k, config.mmr_lambda)
    context = assemble_context(ranked.join(chunks.drop("embedding"), "id"))
    nearest = vector_search_many(documents, asked, 1, id_col="source_file").select("query_id", F.col("id").alias("source_file"))
    overview = nearest.join(documents.select("source_file", "title", "text_summary"), "source_file").select("query_id", F.concat(F.lit("[Document Overview (source: "), F.col("source_file"), F.lit(", title: "), F.col("title"), F.lit(")]\n"), F.col("text_summary")).alias("overview"))
    rows = questions.select("query_id", "question").join(context, "query_id", "left").join(overview, "query_id", "left")
    with_more = F.concat_ws(RULE, F.col("context"), F.when(F.coalesce("n_chunks", F.lit(0)) < k, F.col("overview")))
    rows = rows.select("query_id", "question", with_more.alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            out = []
            for question, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not text:
                    out.append(NOTHING)
                    continue
                ask = ask or (model() if model else extractive)
                out.append(ask(ANSWER_PROMPT, f"Question: {question}\n\nContext:\n{text}").strip())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string()), *batch.columns[2:]], names=["query_id", "question", "answer", "context", "sources"])

    return rows.mapInArrow(run, f"query_id {kind}, question string, answer string, context string, sources array<string>")
