"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are column expressions. On a bounded sample of labelled rows (at most
MAX_TRAIN, those with the smallest keyed hash of doc_id; the bound is a parameter) shallow trees are
boosted on the driver; every path from a root to a node becomes a conjunctive rule; a logistic
regression with lasso penalty over rules and standardised statistics keeps few of them. What is kept
is compiled to one Spark column expression, so scoring all documents is a single narrow scan without
Python. Inputs are statistics of the text only: never doc_id, lang, source or labels.

Defined results: a null text is scored as an empty one; labels that are null, or of a doc_id that is
null or missing in the documents, teach nothing (of several labels of a doc_id the largest counts);
if the labelled rows hold one class only the score is that class, and 1 with no labels at all;
repeated rows get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.staging import spread

MAX_TRAIN = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE = 30, 3, 48, 0.3
#: Lasso strengths tried on a quarter of the sample.
PENALTIES = (0.003, 0.001, 0.0003)

WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics (DOUBLE) of a text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    words = F.regexp_count(t, F.lit(WORD)).cast("double")
    per = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    single = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    distinct = F.size(F.array_distinct(F.split(F.lower(t), " "))).cast("double")
    lines = F.split(t, "\n")
    return {
        "log_chars": F.log1p(n),
        "log_words": F.log1p(words),
        "chars_per_word": per(n, words),
        "upper_runs": per(count(r"\p{Lu}{2,}"), words),
        "capitals": per(count(r"(?<!\p{L})\p{Lu}\p{Ll}"), words),
        "digits": per(count(r"[0-9]"), n),
        "symbols": per(count(r"[#$%&*@^~=_<>{}\[\]\\|]"), n),
        "symbol_runs": per(count(r"[#$%&*!?|]{2,}"), words),
        "bangs": per(single("!"), words),
        "bars": per(single("|"), words),
        "stops": per(count(r"[.?!](?=\s|$)"), words),
        "commas": per(single(","), words),
        "distinct_words": per(distinct, words),
        "lines": per(F.size(lines).cast("double"), words),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): value > threshold where above, else <=."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, at in self.terms:
            out &= (x[:, j] > at) == above
        return out


@dataclass(frozen=True)
class Ensemble:
    names: tuple[str, ...]
    bias: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[int, float, float, float], ...]  # statistic, lowest, highest, weight

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in self.rules:
            z += w * r.holds(x)
        for j, low, high, w in self.linear:
            z += w * np.clip(x[:, j], low, high)
        return 1 / (1 + np.exp(-z))

    def column(self, value) -> Column:
        """The score as a column; ``value(name)`` gives a statistic's column."""
        z = F.lit(float(self.bias))
        for r, w in self.rules:
            terms = [(value(self.names[j]) > at) if above else (value(self.names[j]) <= at) for j, above, at in r.terms]
            both = terms[0]
            for t in terms[1:]:
                both = both & t
            z = z + F.when(both, F.lit(float(w))).otherwise(F.lit(0.0))
        for j, low, high, w in self.linear:
            z = z + F.lit(float(w)) * F.least(F.greatest(value(self.names[j]), F.lit(float(low))), F.lit(float(high)))
        return 1 / (1 + F.exp(-z))


def _tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, terms: tuple, rules: list, out: np.ndarray) -> None:
    """Grow one node; adds its rule, writes leaf values to ``out``."""
    if terms:
        rules.append(Rule(terms))
    g, h = grad[rows].sum(), hess[rows].sum()
    out[rows] = g / (h + 1.0)
    if len(terms) == DEPTH or len(rows) < 20:
        return
    best = (1e-6, -1, -1)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        b = bins[rows, j]
        gs = np.cumsum(np.bincount(b, grad[rows], len(cut) + 1))[:-1]
        hs = np.cumsum(np.bincount(b, hess[rows], len(cut) + 1))[:-1]
        gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
        ns = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
        gain[(ns < 8) | (len(rows) - ns < 8)] = -1
        if (i := int(gain.argmax())) >= 0 and gain[i] > best[0]:
            best = (float(gain[i]), j, i)
    if best[1] < 0:
        return
    _, j, i = best
    low = bins[rows, j] <= i
    at = float(cuts[j][i])
    _tree(bins, cuts, grad, hess, rows[low], (*terms, (j, False, at)), rules, out)
    _tree(bins, cuts, grad, hess, rows[~low], (*terms, (j, True, at)), rules, out)


def _lasso(m: np.ndarray, y: np.ndarray, rows: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on the ``rows`` (0 or 1 each) of ``m`` with an L1 penalty by accelerated proximal gradient."""
    n, p = float(rows.sum()), m.shape[1]
    v = np.random.default_rng(0).normal(size=p).astype(m.dtype)
    for _ in range(20):
        v = m.T @ (rows * (m @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(rows * (m @ v)) ** 2) / n + 0.25 + 1e-9)
    share = np.clip((rows * y).sum() / n, 1e-3, 1 - 1e-3)
    w, b = np.zeros(p, m.dtype), float(np.log(share / (1 - share)))
    wy, by, t = w, b, 1.0
    for _ in range(steps):
        r = rows * (1 / (1 + np.exp(-(m @ wy + np.float32(by)))) - y)
        moved = wy - np.float32(step) * (m.T @ r) / np.float32(n)
        new_w = (np.sign(moved) * np.maximum(np.abs(moved) - np.float32(step * penalty), 0)).astype(m.dtype)
        new_b = by - step * float(r.sum()) / n
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = new_w + np.float32((t - 1) / new_t) * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Ensemble:
    """Fit the ensemble to statistics and labels of 0 and 1 (float arrays)."""
    if not len(y) or y.min() == y.max():
        return Ensemble(names, 40.0 if not len(y) or y[0] > 0.5 else -40.0, (), ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rng = np.random.default_rng(7)
    z = np.zeros(len(y))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        part: list[Rule] = []
        out = np.zeros(len(y))
        _tree(bins, cuts, y - p, p * (1 - p), rows, (), part, out)
        rest = np.setdiff1d(np.arange(len(y)), rows)
        if len(rest):  # rows outside the sample get the value of the deepest rule that holds for them
            for r in part:
                hit = r.holds(x)
                if (hit[rows]).any():
                    value = out[rows[hit[rows]]].mean()
                    out[rest[hit[rest]]] = value
        z += RATE * np.clip(out, -4, 4)
        rules += part
    seen: set[bytes] = set()  # rules that hold for the same rows count once
    masks = [(r, h) for r in rules if (bits := np.packbits(h := r.holds(x)).tobytes()) not in seen and not seen.add(bits)]
    rules = [r for r, _ in masks]
    low, high = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    clipped = np.clip(x, low, high)
    scale = clipped.std(0)
    used = np.flatnonzero(scale > 1e-9)
    middle = clipped.mean(0)
    m = np.empty((len(y), len(rules) + len(used)), np.float32)
    for i, (_, h) in enumerate(masks):
        m[:, i] = h
    m[:, len(rules) :] = 0.4 * (clipped[:, used] - middle[used]) / scale[used]
    y = y.astype(np.float32)
    check = rng.random(len(y)) < 0.25
    if check.all() or not check.any() or y[~check].min() == y[~check].max():
        penalty = PENALTIES[1]
    else:

        def loss(c: float) -> float:
            w, b = _lasso(m, y, (~check).astype(np.float32), c)
            p = np.clip(1 / (1 + np.exp(-(m @ w + np.float32(b))[check].astype(float))), 1e-6, 1 - 1e-6)
            return -float(np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)))

        penalty = min(PENALTIES, key=loss)
    w, b = _lasso(m, y, np.ones(len(y), np.float32), penalty, 600)
    kept = tuple((rules[i], float(w[i])) for i in np.flatnonzero(w[: len(rules)]))
    linear, bias = [], float(b)
    for at, j in enumerate(used):
        if (c := w[len(rules) + at]) != 0:
            slope = 0.4 * c / scale[j]
            bias -= slope * middle[j]
            linear.append((int(j), float(low[j]), float(high[j]), float(slope)))
    return Ensemble(names, bias, kept, tuple(linear))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ensemble:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    stats = statistics(F.col(text_col))
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("_id")).select(F.col("_id"), F.col("_label").cast("double").alias("_y"), *[c.alias(n) for n, c in stats.items()])
    table = rows.toArrow()
    _, first = np.unique(table["_id"].to_numpy(), return_index=True)
    x = np.stack([table[n].to_numpy() for n in stats], 1).astype(float)[first] if len(first) else np.zeros((0, len(stats)))
    return fit(x, table["_y"].to_numpy().astype(float)[first], tuple(stats))


def with_statistics(docs: DataFrame, text_col: str, to: str) -> DataFrame:
    """``docs`` with a struct of the text's statistics, computed once a row: generated code shares what they have in common."""
    return docs.withColumn(to, F.struct(*[c.alias(n) for n, c in statistics(F.col(text_col)).items()]))


def score(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold) added."""
    scored = with_statistics(docs, text_col, "_docloom_stats").withColumn("score", model.column(lambda n: F.col("_docloom_stats")[n]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("_docloom_stats")


def keep_good(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` whose score reaches the threshold, with the columns they have.

    The optimizer would push the filter below the statistics and put each of them in wherever the
    score names it; it leaves filters on a row's number where they are.
    """
    rows = with_statistics(docs, text_col, "_docloom_stats").withColumn("_docloom_row", F.monotonically_increasing_id())
    good = model.column(lambda n: F.col("_docloom_stats")[n]) >= threshold
    return rows.where(good & (F.col("_docloom_row") >= 0)).drop("_docloom_stats", "_docloom_row")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents: doc_id, held_out, score, predicted."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
