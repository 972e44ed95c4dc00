"""Sharding by a reproducible shuffle.

Rows get global numbers in doc_id order (a distributed sort of slim rows and one offset per
partition); a Feistel permutation with cycle walking sends row number i to place p, and p gives
shard p mod k and slot p div k. The law is ``rows``: shard sizes differ by at most one and slots are
gapless from 0. From (number of rows, seed, shards) anyone can compute where a row is, and which row
is at a shard and slot, without reading data: ``locate`` and ``row_at``.

Defined results: null doc_ids come first in the numbering; rows equal in doc_id, size and crc32 are
interchangeable, so repeated rows change nothing but which copy is which; a null text has size 1; an
empty table gives no rows; one shard more is a new shuffle, so grown_shard is null under this law.
Groups of equal texts are spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import work
from docloom.llm.feistel import PRIME, SEARCH, feistel
from docloom.staging import spread

SHARDS = 16
SEED = "docloom-shards-1"


def locate(row: int, rows: int, shards: int = SHARDS, seed: str = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = feistel(rows, seed).permute(row)
    return p % shards, p // shards


def row_at(shard: int, slot: int, rows: int, shards: int = SHARDS, seed: str = SEED) -> int:
    """The row number at a shard's slot."""
    return feistel(rows, seed).invert(slot * shards + shard)


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("_tie", F.monotonically_increasing_id())
    numbered = work.number_rows(slim, F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("_tie"), name="shard-rows").drop("_tie")
    n = numbered.count()
    placed = numbered.withColumn("_p", feistel(n, seed).column(F.col("row_no").cast("long")))
    return placed.select("doc_id", "size", "text_crc32", "row_no", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law ``rows``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def _op4_sql() -> str:
    """The same in SQL: CRC-32 by its table, the domain's factors, the network's rounds and the walk."""

    def f(v: str, k: tuple[int, int, int]) -> str:
        t = f"(({v} + {k[0]}) % {PRIME})"
        t = f"({t} * {t} % {PRIME} * (({v} + {k[1]}) % {PRIME}) % {PRIME})"
        t = f"(({t} * {t} + {k[2]}) % {PRIME})"
        return f"({t} * (({t} + {k[0]}) % {PRIME}) % {PRIME})"

    def once(source: str) -> str:
        for i, k in enumerate(feistel(1, SEED).keys):
            step = f"(l + {f('r', k)}) % a AS l" if i % 2 == 0 else f"(r + {f('l', k)}) % b AS r"
            source = f"(SELECT * REPLACE ({step}) FROM {source})"
        return f"SELECT row_no, n, a, b, l * b + r AS place FROM {source}"

    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS x FROM texts),
summed AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM bytes, crc),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM summed),
counted AS (SELECT count(*) AS n, greatest(CAST(floor(sqrt(count(*))) AS BIGINT), 1) AS root FROM documents),
shape AS (SELECT n, arg_min(c, ((n + c - 1) // c * c - n) * 1000000000 + c) AS a FROM (SELECT n, unnest(range(root, least(root + {SEARCH}, n) + 1)) AS c FROM counted) GROUP BY n),
domain AS (SELECT n, a, (n + a - 1) // a AS b FROM shape),
walk AS (
  {once("(SELECT row_no, n, a, b, row_no // b AS l, row_no % b AS r FROM numbered, domain)")}
  UNION ALL
  {once("(SELECT row_no, n, a, b, place // b AS l, place % b AS r FROM walk WHERE place >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {SHARDS} AS INTEGER) AS shard, place // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, numbered.row_no
FROM numbered JOIN walk ON walk.row_no = numbered.row_no AND place < n
"""


OP4_SQL = _op4_sql()
