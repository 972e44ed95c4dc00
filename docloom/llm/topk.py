"""Exact top-k inner-product search by columnar branch and bound.

Queries and candidates are dealt to a grid of cells, each a block of queries and a block of
candidates of bounded size. In a cell the candidates lie in vertical layout, one row per dimension,
dimensions with the most mass first. Partial inner products are accumulated block by block of
dimensions; after each block a candidate stays only if its partial product plus the Cauchy-Schwarz
bound of the remaining mass (norm of the query's rest times norm of the candidate's rest) can reach
the query's k-th best score so far, and the survivors are compacted before the next block. Candidates
come in slices of falling norm, so thresholds rise early. Every cell gives k rows per query, and the
best k over all cells are the result. It is exact: bounds are rounded outwards and ties are kept.

Defined results: vectors that are null or hold null or non-finite components, and rows without
a vec_id, take no part; vectors of another length than the query's are not its candidates (empty ones
meet empty ones, with score 0); every
different scaled vector of a repeated vec_id is a candidate and asks, and the k best of all their pairs
are the result of the vec_id, while equal rows count once; with fewer than k candidates all are returned;
scores must fit 63 bits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.shipping import ship

SCALE = 64
K = 20
QUERY_ROWS = 2048
CANDIDATE_ROWS = 16384
#: Dimensions accumulated before candidates are dropped again, and candidates of one slice.
DIMS = 16
SLICE = 4096


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, or null if the vector takes no part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(finite, whole)


def branch_and_bound(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, row positions and scores of each query's k best rows in one cell (int64 inputs)."""
    d = rows.shape[1]
    exact = float(d) * float(max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0))) ** 2 < 2.0**53
    kind = np.float64 if exact else np.int64  # products of floats are exact up to 2**53, and faster
    mass = (rows.astype(np.float64) ** 2).sum(0)
    dims = np.argsort(-mass, kind="stable")
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((row_ids, -norms))
    rows, row_ids = rows[order], row_ids[order]
    vertical = np.ascontiguousarray(rows[:, dims].T.astype(kind))
    q = queries[:, dims].astype(kind)
    blocks = [(s, min(s + DIMS, d)) for s in range(0, max(d, 1), DIMS)]
    # norms of what is left after each block, rounded up
    q_rest = [np.sqrt((q[:, e:].astype(np.float64) ** 2).sum(1)) * (1 + 1e-9) for _, e in blocks]
    x_rest = [np.sqrt((vertical[e:].astype(np.float64) ** 2).sum(0)) * (1 + 1e-9) for _, e in blocks]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
    for begin in range(0, len(rows), SLICE):
        end = min(begin + SLICE, len(rows))
        first = q[:, blocks[0][0] : blocks[0][1]] @ vertical[blocks[0][0] : blocks[0][1], begin:end]
        for i in range(len(q)):
            scores, found = best[i]
            floor = scores[-1] if len(scores) == k else None
            at = np.arange(begin, end)
            part = first[i]
            for b, (s, e) in enumerate(blocks):
                if b:
                    part = part + q[i, s:e] @ (vertical[s:e, begin:end] if len(at) == end - begin else vertical[s:e, at])
                if floor is not None:
                    stay = part + q_rest[b][i] * x_rest[b][at] + 1e-3 >= floor
                    if not stay.all():
                        at, part = at[stay], part[stay]
                    if not len(at):
                        break
            if not len(at):
                continue
            own = row_ids[at] != query_ids[i]
            scores = np.concatenate([scores, part[own].astype(np.int64)])
            found = np.concatenate([found, at[own]])
            if len(scores) > 4 * k:  # all that reach the k-th score, ties included
                reach = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                scores, found = scores[reach], found[reach]
            top = np.lexsort((row_ids[found], -scores))[:k]
            best[i] = scores[top], found[top]
    n = [len(s) for s, _ in best]
    return np.repeat(np.arange(len(q)), n), order[np.concatenate([x for _, x in best])] if n else order[:0], np.concatenate([s for s, _ in best]) if n else row_ids[:0]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row where ``is_query``.

    ``is_query`` is a condition on ``vec_id``.
    """
    ship(vectors.sparkSession)
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").distinct()
    n, n_q = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    rows, cols = max(1, -(-n_q // query_rows)), max(1, -(-n // candidate_rows))
    group = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)).cast("int")
    cell = lambda r, c: r * F.lit(cols) + c
    asked = clean.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("_c"), "vec_id", "v").select(cell(group(rows), F.col("_c")).alias("cell"), F.lit(True).alias("asks"), "vec_id", "v")
    held = clean.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_r"), "vec_id", "v").select(cell(F.col("_r"), group(cols)).alias("cell"), F.lit(False).alias("asks"), "vec_id", "v")
    cells = asked.unionByName(held).withColumn("dims", F.size("v"))

    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t.column("asks").to_numpy()
        ids = t.column("vec_id").to_numpy()
        d = t.column("dims")[0].as_py()
        flat = t.column("v").combine_chunks()
        values = np.concatenate([c.flatten().to_numpy() for c in flat.chunks]) if isinstance(flat, pa.ChunkedArray) else flat.flatten().to_numpy()
        v = values.reshape(t.num_rows, d)
        if not asks.any() or asks.all():
            return out.empty_table()
        at, row, score = branch_and_bound(v[asks], ids[asks], v[~asks], ids[~asks], k)
        return pa.Table.from_arrays([pa.array(ids[asks][at]), pa.array(ids[~asks][row]), pa.array(score)], schema=out)

    found = cells.groupBy("cell", "dims").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vec_id divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
