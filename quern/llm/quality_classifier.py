"""Quality classifier: a sparse rule ensemble over statistics of a text.

Small boosted trees on a labelled sample propose rules: the conjunction of thresholds on each path from the
root. Lasso logistic regression, by proximal gradient steps, gives most rules weight 0. The rest becomes a
Spark column expression, so scoring runs on built-in operations.

Learning reads at most `most_docs` labelled rows, those with the smallest seeded hash. Repeated labels merge
to the lowest, and of labelled rows that repeat an id the one with the least statistics is learned from; null labels are
ignored; without labels the score is 0.5. Null and empty texts have all statistics 0 and are scored like any other,
repeated rows each. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import id_fold, one_label, seeded_sample, stored, table
from quern.llm.statistics import FEATURES, feature_columns, labelled_features, with_statistics

MOST_DOCS, SEED = 6000, 2
#: A rule: (feature, above, cut) literals.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, g: np.ndarray, rows: np.ndarray, every: np.ndarray, depth: int, path: Rule, rules: set[Rule], cuts: list[np.ndarray], value: np.ndarray) -> None:
    """Grow a tree on residuals g over rows; put paths into rules, and leaf means into value for every row that falls there."""
    if path:
        rules.add(tuple(sorted(path)))
    best, split = 1e-9, None
    if depth and len(rows) >= 20:
        total, n = g[rows].sum(), len(rows)
        for f, points in enumerate(cuts):
            if not len(points):
                continue
            bin_ = np.searchsorted(points, x[rows, f], side="left")
            s = np.cumsum(np.bincount(bin_, weights=g[rows], minlength=len(points) + 1))[:-1]
            c = np.cumsum(np.bincount(bin_, minlength=len(points) + 1))[:-1]
            ok = (c >= 5) & (n - c >= 5)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, -1)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, split = gain[k], (f, float(points[k]))
    if split is None:
        value[every] = g[rows].mean() if len(rows) else 0.0
        return
    f, cut = split
    low, below = x[rows, f] <= cut, x[every, f] <= cut
    _grow(x, g, rows[low], every[below], depth - 1, (*path, (f, False, cut)), rules, cuts, value)
    _grow(x, g, rows[~low], every[~below], depth - 1, (*path, (f, True, cut)), rules, cuts, value)


def propose(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = SEED) -> list[Rule]:
    rng, rules, margin = np.random.default_rng(seed), set(), np.zeros(len(y))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49)))[:-1] if len(np.unique(x[:, f])) > 1 else np.zeros(0) for f in range(x.shape[1])]
    cuts = [c if len(c) or len(np.unique(x[:, f])) < 2 else np.unique(x[:, f])[:1] for f, c in enumerate(cuts)]
    for _ in range(trees):
        g, value = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        _grow(x, g, rows, np.arange(len(y)), depth, (), rules, cuts, value)
        margin += rate * 4 * value
    return sorted(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient; the bias is free."""
    n, m = a.shape
    w, b, v, vb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(a @ v + vb, -35, 35))) - y
        new = v - step * (a.T @ r) / n
        new, new_b = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0), vb - step * r.mean()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, b


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the bias."""
    if not len(y):
        return [], 0.0
    rules = propose(x, y)
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    seen: dict[bytes, int] = {}
    first = [seen.setdefault(a[:, j].tobytes(), j) == j for j in range(a.shape[1])]
    rules, a = [r for r, f in zip(rules, first) if f], a[:, first] if len(first) else a
    if not rules or len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(p / (1 - p)))
    test = np.arange(len(y)) % 4 == 0
    loss = {}
    for penalty in (0.03, 0.01, 0.003, 0.001):
        w, b = lasso(a[~test], y[~test], penalty)
        z = np.clip(a[test] @ w + b, -35, 35)
        loss[penalty] = float(np.mean(np.log1p(np.exp(-z * (2 * y[test] - 1)))))
    w, b = lasso(a, y, min(loss, key=loss.get))
    return [(r, float(x)) for r, x in zip(rules, w) if abs(x) > 1e-6], float(b)


def as_column(rules: list[tuple[Rule, float]], bias: float) -> Column:
    """The score, 0 to 1, over the counts of with_statistics."""
    features = feature_columns()
    margin = F.lit(bias)
    for rule, weight in rules:
        condition = F.lit(True)
        for f, above, cut in rule:
            c = features[FEATURES[f]]
            condition = condition & (c > F.lit(cut) if above else c <= F.lit(cut))
        margin = margin + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), margin))))


def scored(docs: DataFrame, labelled: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """doc_id and score of each row; labelled has doc_id and label, a row per document to learn from."""
    counted = stored(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rows = labelled_features(counted, seeded_sample(labelled, most_docs, SEED))
    x = np.array([tuple(r["x"]) for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return counted.select("doc_id", as_column(*fit(x, np.array([float(r["label"] > 0) for r in rows]))).alias("score"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = one_label(table(spark, sf_dir, "labels"), "quality", F.min).where(id_fold("doc_id", 5) != 0)
    out = scored(table(spark, sf_dir, "documents"), labelled)
    return out.select("doc_id", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
