"""Quality rules: a decision list learned by sequential covering, run as ordered Spark conditions.

Each rule is a conjunction of thresholds on statistics of a text. It is grown literal by literal on one part
of the labelled rows by FOIL's gain, pruned on the other part, and kept if it is precise enough there. Rows
that it covers are set aside, and the next rule is learned from the rest, until none is good enough. The list
becomes one conditional expression, so texts are judged by built-in operations alone.

Learning reads at most `most_docs` labelled rows, those with the smallest seeded hash. Repeated labels of a
document merge to the lowest, and of labelled rows that repeat an id the one with the least statistics is learned from;
null labels are ignored; without labels, or with one class only, the list is empty and keeps every document. Null and
empty texts have 0 words. Repeated rows are judged each; other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import one_label, seeded_sample, stored, table
from quern.llm.statistics import COUNTS, FEATURES, feature_columns, labelled_features, with_statistics

MOST_DOCS, SEED = 6000, 4


@dataclass(frozen=True)
class Literal:
    """feature > cut, or feature <= cut."""

    feature: int
    above: bool
    cut: float

    def holds(self, x: tuple) -> bool:
        return (x[self.feature] > self.cut) == self.above

    def column(self, features: dict) -> Column:
        c = features[FEATURES[self.feature]]
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut:.6g}"


Row = tuple[tuple, bool]


def _count(rule: list[Literal], rows: list[Row]) -> tuple[int, int]:
    """Rows to reject and rows to keep that the rule covers."""
    bad = good = 0
    for x, reject in rows:
        if all(q.holds(x) for q in rule):
            bad, good = bad + reject, good + (not reject)
    return bad, good


def _best_literal(rows: list[Row], bad: int, good: int) -> tuple[float, Literal | None]:
    """The literal with the most FOIL gain over rows, of which bad and good are covered now."""
    best, found = 0.0, None
    base = math.log2(bad / (bad + good))
    for f in range(len(FEATURES)):
        order = sorted((x[f], reject) for x, reject in rows)
        p = n = 0
        for i, (v, reject) in enumerate(order[:-1]):
            p, n = p + reject, n + (not reject)
            after = order[i + 1][0]
            if after == v:
                continue
            for above, (a, b) in ((False, (p, n)), (True, (bad - p, good - n))):
                if a:
                    gain = a * (math.log2((a + 0.5) / (a + b + 1)) - base)
                    if gain > best + 1e-9:
                        best, found = gain, Literal(f, above, v + (after - v) / 2)
    return best, found


def learn_list(rows: list[Row], most_rules: int = 12, most_literals: int = 4, precision: float = 0.9, least_cover: int = 3) -> list[list[Literal]]:
    """Ordered rules, each of which rejects what it covers. rows: features and whether the label says reject."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[list[Literal]] = []
    while len(rules) < most_rules:
        rule: list[Literal] = []
        covered = grow
        while len(rule) < most_literals:
            bad = sum(r for _, r in covered)
            if not bad or bad == len(covered):
                break
            _, q = _best_literal(covered, bad, len(covered) - bad)
            if q is None:
                break
            rule.append(q)
            covered = [r for r in covered if q.holds(r[0])]
        worth = lambda c: (c[0] - c[1]) / (c[0] + c[1]) if sum(c) else -1.0
        while len(rule) > 1:
            now = worth(_count(rule, prune))
            shorter = max(([q for q in rule if q is not d] for d in rule), key=lambda r: worth(_count(r, prune)))
            if worth(_count(shorter, prune)) < now:
                break
            rule = shorter
        bad, good = _count(rule, prune) if rule else (0, 0)
        if bad < least_cover or bad < precision * (bad + good):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(q.holds(r[0]) for q in rule)] for part in (grow, prune))
    return rules


def as_column(rules: list[list[Literal]]) -> Column:
    """True for rows to keep: the first rule that covers a row rejects it."""
    features = feature_columns()
    out = None
    for rule in rules:
        condition = rule[0].column(features)
        for q in rule[1:]:
            condition = condition & q.column(features)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(counted: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> list[list[Literal]]:
    """The list from counted documents (with_statistics) and their labels."""
    sample = seeded_sample(one_label(labels, "quality", F.min), most_docs, SEED)
    found = labelled_features(counted, sample)
    return learn_list([(tuple(r["x"]), r["label"] == 0) for r in found])


def base_failed() -> Column:
    return (F.col("_st_n_words") < 20) | (100 * F.col("_st_n_repeat_words") > 30 * F.col("_st_n_words"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and others, which mustn't start with _st_) without text, with counts (_st_...), _st_base_failed and _st_kept."""
    counted = stored(with_statistics(docs).drop("text"), "statistics")
    failed = counted.withColumn("_st_base_failed", base_failed())
    return failed.withColumn("_st_kept", ~F.col("_st_base_failed") & as_column(learn(counted, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base checks and the list keep, with their columns."""
    # All columns go along in one, so that no name can clash.
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return judged(rows, labels).where("_st_kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"_st_{c}").alias(c) for c in COUNTS], F.col("_st_base_failed").alias("base_failed"), F.col("_st_kept").alias("kept"))
