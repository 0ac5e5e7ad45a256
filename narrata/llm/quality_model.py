"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are grown on the statistics of labelled documents; every path from a root to a node is a rule, a
conjunction of comparisons. A logistic model with a lasso penalty over these rules and nothing else gives most of
them weight 0. What is left is one Spark column expression, so scoring runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import let, settle, words

#: Labelled documents learned from, at most: those with the least hash of their id.
SAMPLE = 10_000
TREES, DEPTH, BINS, RATE, PENALTY = 40, 3, 32, 0.3, 0.002
STATISTICS = ["n_words", "mean_length", "distinct", "repeated", "symbols", "bars", "bangs", "upper", "digits", "points", "dup_lines", "lines", "long_words"]


def statistics(text: Column) -> Column:
    """A text's statistics as a struct of doubles; a null text counts as empty, whose ratios are all 0."""
    text = F.coalesce(text, F.lit(""))

    def of(x: Column) -> Column:
        w, rest, n = x["w"], x["rest"], x["n"]
        only = lambda kept: F.length(F.regexp_replace(rest, f"[^{kept}]+", ""))
        per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        lines = F.filter(x["lines"], lambda v: v.rlike(r"[^\x20\x09-\x0D]"))
        values = {
            "n_words": F.size(w).cast("double"),
            "mean_length": per(F.length(F.array_join(w, "")), F.size(w)),
            "distinct": per(F.size(F.array_distinct(w)), F.size(w)),
            "repeated": per(F.size(F.filter(w, lambda v, k: F.coalesce(F.get(w, k - 1) == v, F.lit(False)))), F.size(w)),
            "symbols": per(only(r"#*$%&<>=+_@/\\^~"), n),
            "bars": per(only("|"), n),
            "bangs": per(only("!"), n),
            "upper": per(only(r"\p{Lu}"), n),
            "digits": per(only("0-9"), n),
            "points": per(only(".,;:?"), n),
            "dup_lines": let(lines, lambda v: per(F.size(v) - F.size(F.array_distinct(v)), F.size(v))),
            "lines": per(F.size(x["lines"]), F.size(w)),
            "long_words": per(F.size(F.filter(w, lambda v: F.length(v) > 12)), F.size(w)),
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS])

    bound = F.struct(words(text).alias("w"), F.regexp_replace(text, r"[a-z\x09-\x0D\x20]+", "").alias("rest"), F.length(text).alias("n"), F.split(text, "\n").alias("lines"))
    return let(bound, of)


@dataclass
class Rules:
    """A logistic model: bias and (weight, conditions), a condition being (statistic, is over, threshold)."""

    bias: float = 0.0
    rules: list[tuple[float, list[tuple[int, bool, float]]]] = field(default_factory=list)

    def column(self, found: Column) -> Column:
        """The score (0 to 1) as an expression over a struct of statistics."""

        def holds(conditions: list[tuple[int, bool, float]]) -> Column:
            tests = [(found[STATISTICS[k]] > t) if over else (found[STATISTICS[k]] <= t) for k, over, t in conditions]
            return reduce(lambda a, b: a & b, tests)

        logit = reduce(lambda a, r: a + F.when(holds(r[1]), F.lit(r[0])).otherwise(F.lit(0.0)), self.rules, F.lit(self.bias))
        return F.lit(1.0) / (1.0 + F.exp(-logit))

    def predict(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.bias)
        for weight, conditions in self.rules:
            logit += weight * covers(x, conditions)
        return 1 / (1 + np.exp(-logit))


def covers(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    mask = np.ones(len(x), dtype=bool)
    for k, over, t in conditions:
        mask &= x[:, k] > t if over else x[:, k] <= t
    return mask


def tree(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> list[tuple[list, np.ndarray, float]]:
    """Grows a tree by second-order gains; gives each node's path, rows and value (of leaves; else 0)."""
    out, todo = [], [([], np.arange(len(x)), 0)]
    while todo:
        path, rows, level = todo.pop()
        value = lambda r: -g[r].sum() / (h[r].sum() + 1.0)
        best = (1e-3, None, None)
        if level < depth and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for k, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, k], g[rows], len(cuts) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, k], h[rows], len(cuts) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, float(cuts[at]))
        if best[1] is None:
            out.append((path, rows, value(rows)))
            continue
        _, k, t = best
        if path:
            out.append((path, rows, 0.0))
        over = x[rows, k] > t
        todo += [([*path, (k, True, t)], rows[over], level + 1), ([*path, (k, False, t)], rows[~over], level + 1)]
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Rules:
    """Trees, their paths as rules, then lasso logistic weights by accelerated proximal gradient steps."""
    n, ones = len(y), float(y.sum())
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if not n or ones in (0, n):
        return Rules(prior)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    logit, seen = np.full(n, prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        for path, rows, value in tree(x, binned, edges, p - y, p * (1 - p), DEPTH):
            logit[rows] += RATE * value
            if path:
                mask = np.zeros(n, dtype=bool)
                mask[rows] = True
                seen.setdefault(mask.tobytes(), (path, mask))
    paths = [p for p, _ in seen.values()]
    if not paths:
        return Rules(prior)
    matrix = np.stack([m for _, m in seen.values()], axis=1).astype(np.float64)
    scale = np.maximum(matrix.std(axis=0), 1e-3)
    design = (matrix - matrix.mean(axis=0)) / scale
    step = 4.0 * n / max(np.linalg.norm(design, 2) ** 2, 1e-9)
    w, z, b, t = np.zeros(len(paths)), np.zeros(len(paths)), prior, 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(design @ z + b))) - y
        new = z - step * (design.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4.0 * r.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    weights = w / scale
    bias = b - float((matrix.mean(axis=0) * weights).sum())
    kept = [k for k in np.argsort(-np.abs(w)) if abs(w[k]) > 1e-4]
    return Rules(float(bias), [(float(weights[k]), paths[k]) for k in kept])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Rules:
    """Learns from labelled documents for which `learn` (a condition on doc_id) holds; at most `sample` of them.

    Rows with a null id or label teach nothing; an id with several labels is good only if all are. Without
    documents of both kinds the model is a constant.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = settle(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # Ids may repeat among documents: one row of statistics an id keeps what reaches the driver within the sample.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", statistics(F.col("text")).alias("s"))
    found = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("s").alias("s")).orderBy("doc_id").collect()
    return fit_rules(np.array([list(r.s) for r in found], dtype=np.float64).reshape(-1, len(STATISTICS)), np.array([r.quality for r in found], dtype=np.float64))


def score(docs: DataFrame, model: Rules) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts get the score of no words; equal rows score
    alike; an empty table gives an empty result; other columns are not read."""
    found = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    return found.select("doc_id", model.column(F.col("s")).alias("score"))
