"""Embedding columns: deterministic hashes, or any callable in batches, each distinct text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import Config
from docloom.errors import EmbeddingError
from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.shipping import ship
from docloom.staging import library

#: Tokens (estimated) that are sent to a model at once, but for batches of few texts.
BATCH_TOKENS = 16384
#: Takes a list of texts, gives as many vectors.
Embedder = Callable[[list[str]], list[list[float]]]


def check_vectors(texts: list[str], vectors: list[list[float]], dim: int) -> list[list[float]]:
    """The vectors, if there is one of ``dim`` numbers for each text."""
    if len(vectors) != len(texts):
        raise EmbeddingError(f"{len(vectors)} vectors for {len(texts)} texts")
    for v in vectors:
        if len(v) != dim:
            raise EmbeddingError(f"expected {dim} dimensions, got {len(v)}")
    return vectors


def http_embedder(config: Config) -> Callable[[], Embedder]:
    """A factory of clients for an OpenAI-style endpoint; retries 429, 5xx and transport errors with growing pauses."""

    def make() -> Embedder:
        import json
        import time
        import urllib.error
        import urllib.request

        def embed(texts: list[str]) -> list[list[float]]:
            body = json.dumps({"model": config.embedding_model, "input": texts}).encode()
            request = urllib.request.Request(f"{config.embedding_base_url.rstrip('/')}/v1/embeddings", body, {"Content-Type": "application/json"})
            for turn in range(4):
                try:
                    with urllib.request.urlopen(request, timeout=config.embedding_timeout) as reply:
                        data = json.load(reply)["data"]
                    return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
                except urllib.error.HTTPError as e:
                    if turn == 3 or e.code != 429 and e.code < 500:
                        raise EmbeddingError(f"embedding service: {e}") from e
                except OSError as e:
                    if turn == 3:
                        raise EmbeddingError(f"embedding service: {e}") from e
                time.sleep(2**turn)
            raise AssertionError

        return embed

    return make


def local_embedder(config: Config) -> Callable[[], Embedder]:
    """A factory of in-process models; the batch is halved when memory runs out."""

    def make() -> Embedder:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise EmbeddingError("local embedding needs sentence-transformers") from e
        model = SentenceTransformer(config.embedding_local_model)

        def embed(texts: list[str]) -> list[list[float]]:
            try:
                return [[float(x) for x in v] for v in model.encode(texts)]
            except (MemoryError, RuntimeError) as e:
                if len(texts) == 1 or "memory" not in str(e).lower() and not isinstance(e, MemoryError):
                    raise
                half = len(texts) // 2
                return embed(texts[:half]) + embed(texts[half:])

        return embed

    return make


def embed_column(df: DataFrame, text_col: str = "text", to: str = "embedding", config: Config | None = None, factory: Callable[[], Embedder] | None = None) -> DataFrame:
    """``df`` with a vector column.

    Mode hash (or no factory and hash_fallback) is a column expression. Otherwise each distinct text
    is embedded once, in batches of a bounded number of tokens, by one client per task, and the
    vectors are written out; with hash_fallback a failing batch gets hashes instead of an error.
    Every vector has ``embedding_dim`` numbers, or an error says so.
    """
    config = (config or Config(embedding_mode="hash")).checked()
    dim = config.embedding_dim
    if factory is None and config.embedding_mode == "hash":
        return df.withColumn(to, vx.hash_embedding(F.col(text_col), dim).cast("array<float>"))
    ship(df.sparkSession)
    make = factory or (local_embedder(config) if config.embedding_mode == "local" else http_embedder(config))
    batch_size, fallback = config.embedding_batch, config.hash_fallback

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out: list[list[float] | None] = []
            for i, j in batches_of(batch.column(1).to_pylist(), batch_size):
                part = texts[i:j]
                try:
                    embed = embed or make()
                    out += check_vectors(part, embed(part), dim)
                except Exception:
                    if not fallback:
                        raise
                    out += [None] * len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["_text", "_vector"])

    distinct = df.select(F.col(text_col).alias("_text")).where("_text IS NOT NULL").distinct().withColumn("_tokens", tx.token_estimate(F.col("_text")))
    vectors = library.written(distinct.mapInArrow(run, "_text string, _vector array<float>"), "vectors")
    joined = df.join(vectors, df[text_col] == F.col("_text"), "left")
    value = F.coalesce("_vector", vx.hash_embedding(F.col(text_col), dim).cast("array<float>")) if fallback else F.col("_vector")
    return joined.withColumn(to, value).drop("_text", "_vector")


def embed_questions(questions: DataFrame, config: Config | None = None, factory: Callable[[], Embedder] | None = None) -> DataFrame:
    """Questions (query_id, question) with a ``vector``: the instruction goes before the text."""
    config = config or Config(embedding_mode="hash")
    asked = questions.withColumn("_asked", vx.with_instruction(F.col("question"), config.query_instruction))
    return embed_column(asked, "_asked", "vector", config, factory).drop("_asked")


def batches_of(tokens: list[int], rows: int, most: int = BATCH_TOKENS, least: int = 4) -> Iterator[tuple[int, int]]:
    """Slices of texts for one call each: at most ``rows``, and no more than ``least`` if their tokens exceed ``most``."""
    begin = held = 0
    for i, t in enumerate(tokens):
        if i > begin and (i - begin >= rows or i - begin >= least and held + t > most):
            yield begin, i
            begin, held = i, 0
        held += t
    if begin < len(tokens):
        yield begin, len(tokens)
