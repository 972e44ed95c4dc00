"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; its documents are each due rate = target/size-of-source
copies. The whole part is taken at once, the fractional parts are rounded together: documents of a
source are paired, mass (fraction times size) is moved at random from one to the other until one of
the two is integral, which keeps every document's expectation and the source's sum of words. Groups
of FOLD documents, largest first, are folded this way in one task; each leaves at most one fractional
document, and these residuals are folded again, level by level: a reduction tree of log_FOLD(rows)
levels in which no task ever holds more than FOLD documents of a group. What is left of a source at
the root is one document, so the words taken differ from the target by less than one document's
size. All randomness is a keyed hash of the row numbers, so reruns agree.

Defined results: a null text has size 0 and null is a source of its own, ordered last; documents of
size 0 are taken 0 words; repeated rows are documents of their own; an empty table gives no rows;
extra columns are ignored; sources are ordered by code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import work
from docloom.staging import spread

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: The mix's words, of all words; a source's target, of its words.
SHARE = 1.5
MOST = 2
FOLD = 64
SEED = "docloom-mix-1"


def source_targets(rows: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for the sources of ``rows`` (source, size).

    Targets are lambda * weight, capped at most * source_size; each round puts what the capped
    sources leave over on the others by weight, until no target is above its cap. A round is one
    distributed aggregation over the table of sources; only three sums reach the driver.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = work.number_rows(sums, F.col("source").asc_nulls_last(), name="sources", to="_rank")
    ws = F.array(*[F.lit(w) for w in weights])
    table = work.written(ranked.withColumn("_w", F.element_at(ws, (F.col("_rank") % len(weights) + 1).cast("int"))), "source-weights")
    total, weight = table.agg(F.sum("source_size"), F.sum("_w")).first()
    if total is None:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    goal, level, n_capped = share * total, share * total / weight, -1
    while True:
        capped = F.lit(level) * F.col("_w") > F.lit(most) * F.col("source_size")
        full, rest, n = table.agg(F.sum(F.when(capped, F.lit(most) * F.col("source_size")).otherwise(0)), F.sum(F.when(~capped, F.col("_w")).otherwise(0)), F.sum(capped.cast("long"))).first()
        if n == n_capped or not rest:
            break
        level, n_capped = (goal - full) / rest, n
    target = F.when(capped, F.lit(float(most)) * F.col("source_size")).otherwise(F.lit(level) * F.col("_w"))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def _unit(*parts: Column) -> Column:
    """A keyed hash in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _resolved(unit: Column, bit: int) -> Column:
    return F.array(F.struct(unit["row_no"].alias("row_no"), unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), F.lit(bit).alias("bit")))


def fold_units(units: Column, seed: str = SEED) -> Column:
    """Fold an array of struct(row_no, doc_id, size > 0, p) in order of row_no; gives struct(left, done).

    ``left`` is the unit that may still be fractional, ``done`` the others with their bit.
    """
    first = F.element_at(units, 1)

    def step(acc: Column, j: Column) -> Column:
        i = acc["left"]
        size_i, size_j = i["size"].cast("double"), j["size"].cast("double")
        up = F.struct((size_i * (1 - i["p"])).alias("i"), (size_j * j["p"]).alias("j"))  # room above i, mass of j
        down = F.struct((size_i * i["p"]).alias("i"), (size_j * (1 - j["p"])).alias("j"))

        def move(m: Column) -> Column:
            to_i, to_j = F.least(m["up"]["i"], m["up"]["j"]), F.least(m["down"]["i"], m["down"]["j"])
            i_gains = m["u"] * (to_i + to_j) < to_j
            i_ends = F.when(i_gains, m["up"]["i"] <= m["up"]["j"]).otherwise(m["down"]["i"] <= m["down"]["j"])
            p_i = F.when(i_gains, i["p"] + to_i / size_i).otherwise(i["p"] - to_j / size_i)
            p_j = F.when(i_gains, j["p"] - to_i / size_j).otherwise(j["p"] + to_j / size_j)
            stays = F.when(i_ends, F.struct(j["row_no"].alias("row_no"), j["doc_id"].alias("doc_id"), j["size"].alias("size"), p_j.alias("p"))).otherwise(F.struct(i["row_no"].alias("row_no"), i["doc_id"].alias("doc_id"), i["size"].alias("size"), p_i.alias("p")))
            # the one that ends is i at 1 or 0, or j at 0 or 1
            ended = F.when(i_ends & i_gains, _resolved(i, 1)).when(i_ends, _resolved(i, 0)).when(i_gains, _resolved(j, 0)).otherwise(_resolved(j, 1))
            return F.struct(stays.alias("left"), F.concat(acc["done"], ended).alias("done"))

        moves = F.array(F.struct(up.alias("up"), down.alias("down"), _unit(F.lit(seed), i["row_no"], j["row_no"]).alias("u")))
        return F.element_at(F.transform(moves, move), 1)

    none = F.filter(_resolved(first, 0), lambda _: F.lit(False))
    start = F.struct(F.struct(first["row_no"].alias("row_no"), first["doc_id"].alias("doc_id"), first["size"].alias("size"), first["p"].alias("p")).alias("left"), none.alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, fold: int = FOLD, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of ``docs``."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.col(source_col).alias("source")).withColumn("_tie", F.monotonically_increasing_id())
    rows = work.written(work.number_rows(slim, F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id"), F.col("_tie"), name="mix-rows").drop("_tie"), "mix-numbered")
    targets = work.written(source_targets(rows, share, most, weights).withColumn("_sid", F.monotonically_increasing_id()), "targets")
    n_sources, n_rows = targets.count(), rows.count()
    side = work.sized(targets.withColumnRenamed("source", "_source"), n_sources)
    due = rows.join(side, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = due.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate").cast("long")).withColumn("_p", F.col("_rate") - F.col("_whole"))
    due = work.written(due, "due")
    sure = (F.col("size") == 0) | (F.col("_p") == 0)

    unit = F.struct("row_no", "doc_id", "size", F.col("_p").alias("p"))
    level = due.where(~sure).select("_sid", F.floor(F.col("row_no") / fold).cast("long").alias("_bucket"), unit.alias("unit"))
    width, done = fold, []
    while True:
        folded = level.groupBy("_sid", "_bucket").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = work.written(folded.select("_sid", "_bucket", fold_units(F.col("units"), seed).alias("f")), "folded")
        done.append(folded.select("_sid", F.explode("f.done").alias("d")).select("_sid", "d.*"))
        if width >= max(n_rows, 1):
            break
        width *= fold
        level = folded.select("_sid", F.floor(F.col("_bucket") / fold).cast("long").alias("_bucket"), F.col("f.left").alias("unit"))
    root = folded.select("_sid", "f.left.*")
    bit = (_unit(F.lit(seed), F.col("row_no"), F.lit("root")) < F.col("p")).cast("int")
    done.append(root.select("_sid", "row_no", "doc_id", "size", bit.alias("bit")))
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionByName(more)
    by_id = work.sized(targets.select("_sid", "source", "source_size", "target"), n_sources)
    rounded = rounded.join(by_id, "_sid").withColumn("_rate", rate)
    rounded = rounded.select("doc_id", "size", "source", "source_size", "target", (F.floor("_rate").cast("long") + F.col("bit")).alias("copies"))
    whole = due.where(sure).select("doc_id", "size", "source", "source_size", "target", F.col("_whole").alias("copies"))
    return whole.unionByName(rounded).withColumn("taken", F.col("copies") * F.col("size"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
