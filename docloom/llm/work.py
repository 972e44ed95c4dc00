"""Shared plumbing of the corpus operators: working tables, row numbers, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.staging import Staging

#: A side of a join is broadcast up to this many (slim) rows; beyond it the join is a shuffle join.
BROADCAST_ROWS = 50_000

_LOW33 = (1 << 33) - 1


#: The working tables of these operators' runs; each thread's are its own.
own = Staging()
new_path, written, bucketed, discard, release = own.new_path, own.written, own.bucketed, own.discard, own.release


def number_rows(df: DataFrame, *order: Column, name: str = "rows", to: str = "row_no") -> DataFrame:
    """Add gapless global row numbers (from 0) in the given order, without a single-task window.

    A range-partitioned sort numbers rows inside each partition; the partitions' sizes (one row per
    partition, so as many as spark.sql.shuffle.partitions) are summed to offsets and joined back.
    Rows equal in ``order`` are numbered arbitrarily among themselves: order by all that matters.
    """
    slim = written(df, name)  # the sort samples its input first: it shouldn't be computed twice
    placed = written(slim.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), name)
    discard(slim)
    part = F.shiftright("_mid", 33)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(F.col("_mid").bitwiseAND(F.lit(_LOW33))) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(to, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33)))
        .drop("_part", "_off", "_mid")
    )


def sized(side: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it was counted to be small, as it is otherwise."""
    return F.broadcast(side) if rows <= limit else side
