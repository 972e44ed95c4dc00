"""Search over whole tables of questions: vectors, BM25, fusion, re-ranking.

A question table has query_id and what the operator needs (question, vector). Every result has
query_id and rank from 1; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.shipping import ship
from docloom.staging import library

#: Questions whose vectors are sent to every task at once; more are answered in blocks of this size.
QUERY_BLOCK = 2048
K1, B = 1.2, 0.75


def all_in(array: Column, names: list[str]) -> Column:
    """Whether an array holds all ``names``, exactly."""
    ok = F.lit(True)
    for n in names:
        ok = ok & F.array_contains(array, n)
    return ok


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """rank 1 to k within each query_id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


# -- vectors


def vector_search(index: DataFrame, vector: list[float], k: int = 10, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest rows by cosine distance to one vector, filtered before ranking: a top-k in one pass.

    Rows without a usable vector come last, never first.
    """
    rows = index if where is None else index.where(where)
    query = F.array(*[F.lit(float(v)) for v in vector])
    return rows.withColumn("distance", _distance(F.col(vector_col), query)).orderBy(F.col("distance").asc_nulls_last(), id_col).limit(k)


def _distance(a: Column, b: Column) -> Column:
    """1 - cosine, not below 0; null where a vector is missing or zero."""
    lengths = vx.norm(a) * vx.norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), F.greatest(F.lit(0.0), 1 - vx.dot(a, b) / lengths))


def document_search(documents: DataFrame, vector: list[float] | None = None, tags: list[str] | None = None, k: int | None = 5) -> DataFrame:
    """Documents that carry all ``tags``; with a vector the k nearest that have one, without all (or k by source_file)."""
    rows = documents.where(all_in(F.col("tags"), tags)) if tags else documents
    if vector is not None:
        return vector_search(rows.where("embedding IS NOT NULL"), vector, k or 5, id_col="source_file")
    return rows if k is None else rows.orderBy("source_file").limit(k)


def vector_search_many(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, distance, rank of the k nearest rows for every query (query_id, vector).

    A block of at most ``block`` query vectors goes to every task, which keeps k rows a query of its
    partition; only those meet in the shuffle. Further blocks are further passes over the index, each
    written out, so a plan holds one block only.
    """
    ship(index.sparkSession)
    n = queries.count()
    blocks = max(1, -(-n // block))
    kind = index.schema[id_col].dataType.simpleString()
    slim = index.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found: DataFrame | None = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        held = part.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>")).toArrow()
        if not held.num_rows:
            continue
        names = held.column(0).combine_chunks()
        vectors = np.array([np.array(v, float) for v in held.column(1).to_pylist()])
        lengths = np.linalg.norm(vectors, axis=1)
        sent = index.sparkSession.sparkContext.broadcast((names, vectors, lengths))
        near = slim.mapInArrow(_nearest(sent, k), f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, distance double")
        if blocks > 1:
            near = library.written(top(near, k, F.col("distance"), F.col("id")).drop("rank"), "nearest")
            sent.destroy()
        found = near if found is None else found.unionByName(near)
    if found is None:
        return index.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, distance double, rank int")
    return top(found, k, F.col("distance"), F.col("id"))


def _nearest(sent: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, lengths = sent.value
        for batch in batches:
            d = vectors.shape[1]
            rows = batch.column(1)
            fits = np.array([len(v) == d if v is not None else False for v in rows.to_pylist()], bool)
            batch = batch.filter(pa.array(fits))
            if not len(batch):
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            size = np.linalg.norm(v, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = 1 - (vectors @ v.T) / (lengths[:, None] * size[None, :])
            distance = np.where(np.isfinite(distance), np.maximum(distance, 0), np.inf)
            take = min(k, len(size))
            kth = np.partition(distance, take - 1, axis=1)[:, take - 1 : take]
            q, i = np.nonzero((distance <= kth) & np.isfinite(distance))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(i)), pa.array(distance[q, i])], names=["query_id", "id", "distance"])

    return run


# -- full text


def text_index(docs: DataFrame, id_col: str = "id", text_col: str = "text", compat: bool = False) -> DataFrame:
    """id, doc_len, terms: the tokens of every text, as a written table; what is searched is tokenised here and once."""
    bound = F.transform(F.array(tx.index_tokens(F.col(text_col), compat)), lambda t: F.struct(F.size(t).alias("doc_len"), t.alias("terms")))
    return library.written(docs.select(F.col(id_col).alias("id"), F.element_at(bound, 1).alias("t")).select("id", "t.doc_len", "t.terms"), "text-index")


def postings(index: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """term, id, tf, doc_len of a ``text_index``: the inverted index, one row per term and text, of the terms ``asked`` for or of all."""
    rows = index.select("id", "doc_len", F.explode("terms").alias("term"))
    if asked is not None:
        rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n (texts) and avgdl (mean number of tokens) of a ``text_index``."""
    return index.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))


def bm25(index: DataFrame, queries: DataFrame, k: int | None = 10, compat: bool = False) -> DataFrame:
    """query_id, id, score, rank over a ``text_index``: BM25 with a floor of 1e-6 for the weight of very common terms.

    Terms are OR-ed; a term asked twice counts twice. Only tokens that are asked for leave their
    text's row, and they are counted before document frequencies are.
    """
    terms = F.transform(F.array(tx.query_terms(F.col("question"), compat)), lambda t: t)
    asked = queries.select("query_id", F.element_at(terms, 1).alias("terms")).select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = library.written(asked, "asked-terms")
    n, avgdl = corpus_stats(index).first()
    tf, length = F.col("tf"), F.col("doc_len") / F.lit(avgdl or 1.0)
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    met = library.written(postings(index, asked).select("term", "id", weight.alias("w")), "postings")
    df = met.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(df, "term").select("query_id", "term", (F.col("times") * F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)).alias("q"))
    scored = met.join(library.written(terms, "weighted-terms"), "term").groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    scored = scored.withColumn("score", F.round("score", 9))
    return scored if k is None else top(scored, k, F.desc("score"), F.col("id"))


# -- fusion


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int = 10, rrf_k: int = 60, mode: str = "vector_anchored") -> DataFrame:
    """query_id, id, score, rank by reciprocal rank fusion of two ranked results.

    A missing rank counts as one more than the longer list. ``vector_anchored`` keeps the vector
    hits only (text hits re-order them); ``union`` keeps both.
    """
    v = vector_hits.select("query_id", "id", F.col("rank").alias("v"))
    t = text_hits.select("query_id", "id", F.col("rank").alias("t"))
    sizes = v.select("query_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(t.select("query_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    longest = sizes.groupBy("query_id").agg((F.greatest(F.sum("a"), F.sum("b"), F.lit(1)) + 1).alias("absent"))
    both = v.join(t, ["query_id", "id"], "left" if mode == "vector_anchored" else "full").join(longest, "query_id")
    score = 1.0 / (F.coalesce("t", "absent") + rrf_k) + 1.0 / (F.coalesce("v", "absent") + rrf_k)
    return top(both.withColumn("score", score), k, F.desc("score"), F.col("v").asc_nulls_last(), F.col("id")).select("query_id", "id", "score", "rank")


def hybrid_search(index: DataFrame, queries: DataFrame, k: int = 10, rrf_k: int = 60, mode: str = "vector_anchored", compat: bool = False) -> DataFrame:
    """query_id, id, score, rank for questions (query_id, question, vector) over chunks (id, text, embedding).

    Questions without a vector are answered by text alone, blank ones by the vector alone.
    """
    q = queries.select("query_id", "question", "vector")
    hits = bm25(text_index(index, compat=compat), q.where("question IS NOT NULL"), k, compat)
    near = vector_search_many(index, q.where("vector IS NOT NULL"), k)
    fused = fuse(near, hits, k, rrf_k, mode)
    blind = q.where("vector IS NULL").select("query_id")
    return fused.unionByName(hits.join(blind, "query_id", "left_semi").select("query_id", "id", "score", "rank"))


def embeddings_by_ids(index: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """query_id, pos, id, embedding for wanted (query_id, ids), in the order of ids; unknown ids give null."""
    rows = wanted.select("query_id", F.posexplode("ids").alias("pos", "id"))
    return rows.join(index.select(F.col(id_col).alias("id"), "embedding"), "id", "left").select("query_id", "pos", "id", "embedding")


# -- re-ranking


def rerank_lexical(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, question, text, rank) by lexical score; ``rank`` breaks ties and is replaced."""
    scored = candidates.withColumn("score", tx.lexical_score(F.col("question"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order))


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> list[int]:
    """Greedy maximal marginal relevance: balance * relevance - (1 - balance) * the closest chosen."""
    n = len(relevance)
    size = np.linalg.norm(vectors, axis=1) if n else np.zeros(0)
    unit = vectors / np.where(size > 0, size, 1)[:, None]
    closest = np.zeros(n)
    left = np.ones(n, bool)
    out: list[int] = []
    while len(out) < min(k, n):
        value = np.where(left, balance * relevance - (1 - balance) * closest, -np.inf)
        i = int(value.argmax())
        same = unit @ unit[i]
        closest = same if not out else np.maximum(closest, same)
        out.append(i)
        left[i] = False
    return out


def mmr_rerank(candidates: DataFrame, k: int = 5, balance: float = 0.7) -> DataFrame:
    """Candidates (query_id, question, id, text, embedding, rank), re-ranked for each question.

    With at most k candidates only lexical relevance orders them; otherwise k are chosen greedily.
    A question's candidates are a search result, so a group is small.
    """
    ship(candidates.sparkSession)
    scored = candidates.withColumn("score", tx.lexical_score(F.col("question"), F.col("text"))).select("query_id", "id", "rank", "score", F.col("embedding").cast("array<double>").alias("embedding"))
    q, i = (scored.schema[c].dataType.simpleString() for c in ("query_id", "id"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("rank", "ascending"), ("id", "ascending")])
        score = t.column("score").to_numpy()
        if t.num_rows <= k:
            order = np.argsort(-score, kind="stable")
        else:
            lists = [np.array(v or [], float) for v in t.column("embedding").to_pylist()]
            width = max(map(len, lists))
            order = np.array(mmr_order(score, np.array([np.pad(v, (0, width - len(v))) for v in lists]), k, balance))
        picked = t.take(pa.array(order))
        return pa.table({"query_id": picked.column("query_id"), "id": picked.column("id"), "score": picked.column("score"), "rank": pa.array(np.arange(1, len(order) + 1, dtype=np.int32))})

    return scored.groupBy("query_id").applyInArrow(run, f"query_id {q}, id {i}, score double, rank int")
