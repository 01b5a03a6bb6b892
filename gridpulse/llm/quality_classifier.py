"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees over a bounded labelled sample give conjunctive rules
(every path from a root is one); a logistic regression with lasso penalty
keeps few of them; these become one Spark column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm._stats import free_name, with_counts

#: Labelled rows the ensemble is fitted on, those with the smallest hash of doc_id.
MOST_LABELLED = 20_000
TREES, DEPTH, BINS, LEAST_LEAF = 24, 3, 32, 10
SHRINK = 0.3
PENALTIES = (0.03, 0.01, 0.003, 0.001)
CUT = 0.5


def statistics(count: Column) -> dict[str, Column]:
    """The statistics that rules speak about; all are 0 for an empty text."""
    words = F.greatest(count["n_words"], F.lit(1))
    chars = F.greatest(count["word_chars"], F.lit(1))
    lines = F.greatest(count["n_lines"], F.lit(1))
    letters = F.greatest(count["n_upper"] + count["n_lower"], F.lit(1))
    return {
        "n_words": count["n_words"].cast("double"),
        "word_length": count["word_chars"] / words,
        "words_per_line": count["n_words"] / lines,
        "repeated_lines": count["n_dup_lines"] / lines,
        "repeated_words": count["n_repeat_words"] / words,
        "distinct_words": count["n_distinct_words"] / words,
        "short_words": count["n_short_words"] / words,
        "long_words": count["n_long_words"] / words,
        "full_lines": count["n_full_lines"] / lines,
        "symbols": count["n_symbols"] / chars,
        "upper": count["n_upper"] / letters,
        "digits": count["n_digits"] / chars,
        "bars": count["n_bars"] / words,
        "marks": count["n_marks"] / words,
        "stops": count["n_stops"] / words,
        "quotes": count["n_quotes"] / words,
    }


@dataclass(frozen=True)
class Rule:
    """(statistic number, is above, threshold) conditions that all hold, and the rule's weight."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, at in self.conditions:
            out &= (x[:, k] > at) if above else (x[:, k] <= at)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, stats: dict[str, Column]) -> Column:
        """Probability of label 1 as a column expression over ``stats``."""
        columns = list(stats.values())
        total = F.lit(self.intercept)
        for rule in self.rules:
            held = F.lit(True)
            for k, above, at in rule.conditions:
                held = held & ((columns[k] > F.lit(at)) if above else (columns[k] <= F.lit(at)))
            total = total + F.when(held, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray,
           rows: np.ndarray, path: tuple, found: list, values: np.ndarray) -> None:
    """Grow one tree below ``path``; adds each node's path to ``found`` and leaf values to ``values``."""
    if path:
        found.append(path)
    total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if len(path) < DEPTH:
        for k, at in enumerate(edges):
            if not len(at):
                continue
            size = np.bincount(binned[rows, k], minlength=len(at) + 1).cumsum()[:-1]
            g = np.bincount(binned[rows, k], gradient[rows], minlength=len(at) + 1).cumsum()[:-1]
            h = np.bincount(binned[rows, k], hessian[rows], minlength=len(at) + 1).cumsum()[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(size < LEAST_LEAF) | (len(rows) - size < LEAST_LEAF)] = 0
            top = int(gain.argmax())
            if gain[top] > best[0]:
                best = (gain[top], k, top)
    if best[1] is None:
        values[rows] += SHRINK * total_g / (total_h + 1)
        return
    _, k, top = best
    low = binned[rows, k] <= top
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _paths(x, binned, edges, gradient, hessian, part, (*path, (k, above, float(edges[k][top]))), found, values)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct paths of boosted trees, in the order in which they were grown."""
    edges = []
    for k in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        edges.append(cuts[cuts < x[:, k].max()])
    binned = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    margin = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: list = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        _paths(x, binned, edges, y - p, p * (1 - p), np.arange(len(y)), (), found, margin)
    return [Rule(path) for path in dict.fromkeys(tuple(sorted(path)) for path in found)]


def lasso(held: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights of 0/1 columns under an L1 penalty, by accelerated proximal steps."""
    a = np.column_stack([np.ones(len(y)), held.astype(float)])
    step = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -40, 40)))
        new = v - step * (a.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / later * (new - w)
        w, t = new, later
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules from all rows; the penalty is that with the least loss on a fifth held back."""
    if not len(y) or y.min() == y.max():
        return Ensemble(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0, ())
    rules = tree_rules(x, y)
    held = np.column_stack([r.holds(x) for r in rules]) if rules else np.zeros((len(y), 0))
    back = np.arange(len(y)) % 5 == 4
    losses = []
    for penalty in PENALTIES:
        b, w = lasso(held[~back], y[~back], penalty, 200)
        p = np.clip(1 / (1 + np.exp(-(b + held[back] @ w))), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)))
    b, w = lasso(held, y, PENALTIES[int(np.argmin(losses))])
    return Ensemble(b, tuple(Rule(r.conditions, float(c)) for r, c in zip(rules, w) if abs(c) > 1e-4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ensemble:
    """Fit on at most ``most`` labelled rows that are not held out.

    A doc_id with several labels has the one most of them give (1 on a tie).
    """
    known = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # at most ``most`` rows of 16 bytes
    sample = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    counted = with_counts(sample, "count", ["doc_id", "label"])
    stats = statistics(F.col("count"))
    rows = counted.select("doc_id", "label", *[v.alias(k) for k, v in stats.items()]).toPandas()
    rows = rows.sort_values(list(rows.columns)).drop_duplicates("doc_id")
    order = np.random.default_rng(0).permutation(len(rows))
    return fit(rows[list(stats)].to_numpy(float)[order], rows["label"].to_numpy(float)[order])


def scored(documents: DataFrame, model: Ensemble) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have statistics of 0 and are scored by the rules
    like any others. Repeated rows are scored each. Columns other than
    doc_id and text are not read. An empty table gives no rows.
    """
    counted = with_counts(documents, "count", ["doc_id"])
    score = model.score(statistics(F.col("count")))
    return counted.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
    ).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted_documents(documents: DataFrame, model: Ensemble) -> DataFrame:
    """The rows of ``documents`` predicted 1."""
    name = free_name(documents, "corpus_counts")
    counted = with_counts(documents, name, documents.columns)
    return counted.where(model.score(statistics(F.col(name))) >= CUT).drop(name)


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
