"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are Spark columns of the whole text. A bounded sample of labelled rows (SAMPLE, the smallest hashes of
doc_id) goes to the driver; shallow boosted trees give paths, each path from the root is a conjunctive rule, and a
logistic regression with an L1 penalty weighs the rules. The rules that keep a weight are compiled into one Spark
column, so scoring is a projection without Python.

Only rows with crc32(doc_id as text) mod 5 other than 0 are learnt from. Labels, lang, source and doc_id are no inputs
of a score. Null texts count as empty; labels that are null or neither 0 nor 1 are ignored; without labels of both kinds
the score is the share of label 1, or 0.5. Rows that repeat an id are scored by their own texts, and count each time in
the sample; long texts are read whole; ties of the sample's order have equal ids, so equal columns. An empty table gives
an empty table. Columns of ``docs`` pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, RATE, CUTS = 24, 3, 0.3, 32
PENALTY = 0.002


def statistics(text: str = "text") -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)

    def count(chars: str) -> Column:
        return n - F.length(F.translate(t, chars, ""))

    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n_words = F.size(words)
    lines = F.split(t, "\n")

    def part(x: Column, of: Column) -> Column:
        return F.round(x / F.greatest(of, F.lit(1)).cast("double"), 6)

    return {
        "upper": part(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        "digits": part(count("0123456789"), n),
        "stops": part(count(".,"), n_words),
        "shouts": part(count("!?"), n_words),
        "bars": part(count("|"), n_words),
        "symbols": part(count("#$%&*@^~<>{}[]=+_\\/"), n),
        "words": n_words.cast("double"),
        "length": part(n, n_words),
        "distinct": part(F.size(F.array_distinct(words)), n_words),
        "repeats": part(F.size(F.array_distinct(lines)), F.size(lines)),
    }


class Rules:
    """bias, and weighted conjunctions of (statistic, above, cut)."""

    def __init__(self, bias: float, rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]]):
        self.bias, self.rules = bias, rules

    def column(self, stats: list[Column]) -> Column:
        z = F.lit(self.bias)
        for weight, path in self.rules:
            test = None
            for i, above, cut in path:
                one = stats[i] > F.lit(cut) if above else stats[i] <= F.lit(cut)
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _matrix(x: np.ndarray, paths: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(paths)), bool)
    for j, path in enumerate(paths):
        for i, above, cut in path:
            out[:, j] &= (x[:, i] > cut) == above
    return out


def tree_paths(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Paths of boosted trees for logistic loss, with cuts at quantiles."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 1)[1:-1])) for i in range(x.shape[1])]
    place = [np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]  # place <= k: x <= cuts[k]
    f, paths = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        todo = [(np.arange(len(y)), ())]
        for depth in range(DEPTH):
            grown = []
            for rows, path in todo:
                best = (1e-3, None)
                base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for i, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(place[i][rows], g[rows], len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(place[i][rows], h[rows], len(c) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - base
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (i, k))
                if best[1] is None:
                    f[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                i, k = best[1]
                low = place[i][rows] <= k
                for above, part in ((False, rows[low]), (True, rows[~low])):
                    new = (*path, (i, above, float(cuts[i][k])))
                    paths.add(tuple(sorted(new)))
                    if depth + 1 == DEPTH:
                        f[part] += RATE * g[part].sum() / (h[part].sum() + 1)
                    else:
                        grown.append((part, new))
            todo = grown
    return sorted(paths)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights, by accelerated proximal gradient steps."""
    a = a.astype(np.float64)
    n, m = a.shape
    step = 4 * n / (np.linalg.norm(np.column_stack([np.ones(n), a]), 2) ** 2 + 1e-9)
    w, v, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    w[0] = v[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(v[0] + a @ v[1:]))) - y
        new = v - step * np.concatenate([[r.mean()], a.T @ r / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    learn = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    learn = learn.select("doc_id", F.col("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    stats = statistics()
    rows = docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id").select("y", *(c.alias(k) for k, c in stats.items())).toPandas()
    y = rows["y"].to_numpy(np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Rules(float(np.log((share + 1e-3) / (1 - share + 1e-3))), [])
    order = np.lexsort([rows[c].to_numpy() for c in rows.columns])
    x, y = rows.drop(columns="y").to_numpy(np.float64)[order], y[order]
    paths = tree_paths(x, y)
    bias, weights = lasso_logistic(_matrix(x, paths), y, PENALTY)
    return Rules(bias, [(float(w), p) for w, p in zip(weights, paths, strict=True) if abs(w) > 1e-6])


def score(docs: DataFrame, rules: Rules) -> tuple[DataFrame, str]:
    """``docs`` with one more column, the score, and its name. The statistics are computed once and hidden."""
    stats = statistics()
    name, *names = unused(docs, "score", *stats)
    with_stats = docs.withColumns(dict(zip(names, stats.values(), strict=True)))
    return with_stats.withColumn(name, rules.column([F.col(n) for n in names])).drop(*names), name


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored, name = score(docs.select("doc_id", "text"), fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    scored, name = score(docs, fit(docs, labels))
    return scored.where(F.col(name) >= THRESHOLD).select(*docs.columns)
