"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import work
from docloom.shipping import ship

#: So many links fit into one task (16 bytes each, and as much again to work with); more go through rounds of joins.
SMALL = 1 << 20


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in links (a, b), and for each the smallest id that can be reached."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)  # the old labels' owners follow
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns] for batch in batches]
        ids, comp = smallest_reachable(*(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in held)]) for i in (0, 1)))
        for s in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + (1 << 16)]), pa.array(comp[s : s + (1 << 16)])], names=["id", "comp"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "id bigint, comp bigint")


def connected(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(id, comp) for every id in ``edges`` (a, b): comp is the smallest id that can be reached.

    Up to ``small`` links are joined in one task. Beyond, each round lowers every label to the
    smallest one next to it and then follows the label's own label, so long chains shrink
    geometrically. Labels are written out after each round, and the round before's deleted.
    """
    ship(edges.sparkSession)
    links = work.written(edges.select("a", "b").where("a <> b"), "cc-links")
    if links.count() <= small:
        return work.written(_in_one_task(links), "cc-labels")
    both = work.written(links.union(links.select("b", "a")).distinct(), "cc-edges")
    labels = work.written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_m")).select("id", F.least("id", "_m").alias("comp")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("_c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_c"))
        lower = labels.join(near, "id").select("id", F.col("comp").alias("_was"), F.least("comp", "_c").alias("comp"))
        # following: the label of the label; many ids share a label, so hot labels are joined as the skewed side
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("_up"))
        jumped = lower.join(up, "comp", "left").select("id", "_was", F.least("comp", F.coalesce("_up", "comp")).alias("comp"))
        new = work.written(jumped, "cc-labels")
        work.discard(labels)
        changed = not new.where("comp <> _was").isEmpty()
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    work.discard(both, links)
    return labels.select("id", "comp")
