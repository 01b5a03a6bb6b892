"""Logistic regression by distributed Newton steps.

Every step is one aggregate over the rows: loss, gradient and Hessian are
sums of column expressions, so partial sums combine before the exchange and
a dozen numbers reach the driver, which solves a system as wide as the
features. Nested feature sets advance together, each by sums of its own
weights, in the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.operators.signals import TARGET
from gridpulse.schemas import FEATURES

MOST_STEPS = 100
#: A set is done when its next step moves no weight by more than this.
TOLERANCE = 1e-11
#: Relative rise of the summed loss that the rounding of a long sum may cause; a smaller one says nothing about a step.
LOSS_NOISE = 1e-9
#: Steps below this shrink quadratically; one that does not is the rounding of the sums.
SMALL_STEP = 1e-8


@dataclass(frozen=True)
class Fit:
    """Weights on features standardised by the mean and the population deviation of the training rows."""

    features: list[str]
    mean: dict[str, float]
    deviation: dict[str, float]
    intercept: float
    weights: list[float]

    def logit(self) -> Column:
        terms = [F.lit(w) * _standard(f, self.mean, self.deviation) for f, w in zip(self.features, self.weights)]
        return sum(terms, F.lit(self.intercept))


def _standard(name: str, mean: dict[str, float], deviation: dict[str, float]) -> Column:
    return (F.col(name) - mean[name]) / deviation[name]


def moments(rows: DataFrame, names: list[str]) -> tuple[dict[str, float], dict[str, float], int, int]:
    """Means, population deviations, positive and negative rows; a constant feature has deviation 1, so it becomes 0."""
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names],
        F.count_if(F.col(TARGET) == 1).alias("p"), F.count_if(F.col(TARGET) == 0).alias("n"),
    ).first()
    return {c: stats[f"m_{c}"] for c in names}, {c: stats[f"s_{c}"] or 1.0 for c in names}, stats["p"], stats["n"]


def _sums(fit: Fit, name: str) -> list[Column]:
    """Loss, gradient and upper triangle of the Hessian of a set at its weights."""
    ones = [F.lit(1.0), *[_standard(f, fit.mean, fit.deviation) for f in fit.features]]
    z, y = fit.logit(), F.col(TARGET).cast("double")
    p = 1.0 / (1.0 + F.exp(-z))
    curve = p * (1.0 - p)
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    gradient = [F.sum((p - y) * x) for x in ones]
    hessian = [F.sum(curve * ones[i] * ones[j]) for i in range(len(ones)) for j in range(i, len(ones))]
    return [c.alias(f"{name}_{k}") for k, c in enumerate([F.sum(loss), *gradient, *hessian])]


def fit_sets(rows: DataFrame, sets: dict[str, list[str]], c: float = 1.0) -> dict[str, Fit]:
    """Minimise the summed loss plus ``|w|^2 / (2 c)`` (intercept free) for every feature set.

    ``rows`` are labelled rows without nulls, read once for the moments and
    once a step: pass a stored table. The steps start at the base rate, the
    optimum without features. A step that raises the loss by more than the
    rounding of its sum is halved. Only one class, or no row, has no fit and
    raises.
    """
    names = sorted({f for features in sets.values() for f in features})
    mean, deviation, positive, negative = moments(rows, names)
    if not positive or not negative:
        raise ValueError("both classes are needed for a fit")
    at = {k: np.array([np.log(positive / negative), *[0.0] * len(f)]) for k, f in sets.items()}
    moved = dict.fromkeys(sets, np.inf)
    last = {k: (np.inf, at[k], np.zeros_like(at[k])) for k in sets}
    done: dict[str, Fit] = {}

    def made(name: str) -> Fit:
        intercept, *weights = at[name].tolist()
        return Fit(list(sets[name]), mean, deviation, intercept, weights)

    for _ in range(MOST_STEPS):
        ahead = [k for k in sets if k not in done]
        if not ahead:
            return done
        sums = rows.agg(*[x for i, k in enumerate(ahead) for x in _sums(made(k), f"s{i}")]).first()
        for i, k in enumerate(ahead):
            w, d = at[k], len(at[k])
            values = np.array([sums[f"s{i}_{j}"] for j in range(1 + d + d * (d + 1) // 2)])
            penalty = np.diag([0.0, *[1.0 / c] * (d - 1)])
            loss = values[0] + w @ penalty @ w / 2
            before, start, step = last[k]
            if loss > before * (1 + LOSS_NOISE) + 1e-12:
                last[k] = before, start, step / 2
                at[k] = start - step / 2
                moved[k] = np.inf
                continue
            hessian = np.zeros((d, d))
            hessian[np.triu_indices(d)] = values[1 + d :]
            hessian = hessian + np.triu(hessian, 1).T + penalty
            factor = np.linalg.cholesky(hessian)
            step = np.linalg.solve(factor.T, np.linalg.solve(factor, values[1 : 1 + d] + penalty @ w))
            last[k] = loss, w, step
            at[k] = w - step
            size = np.abs(step).max() / max(1.0, np.abs(w).max())
            if size <= TOLERANCE or (size <= SMALL_STEP and size > moved[k] / 2):
                done[k] = made(k)
            moved[k] = size
    raise ArithmeticError(f"no convergence in {MOST_STEPS} steps: {sorted(set(sets) - set(done))}")


def fit(rows: DataFrame, features: list[str] = FEATURES, c: float = 1.0) -> Fit:
    return fit_sets(rows, {"all": features}, c)["all"]


def score(model: Fit, features: DataFrame) -> DataFrame:
    """Adds ``risk_score``, a column expression."""
    return features.withColumn("risk_score", 1.0 / (1.0 + F.exp(-model.logit())))


def coefficients(model: Fit, spark: SparkSession) -> DataFrame:
    """(feature, coefficient, direction, intercept); as many rows as features."""
    rows = [(f, w, model.intercept) for f, w in zip(model.features, model.weights)]
    frame = spark.createDataFrame(rows, "feature string, coefficient double, intercept double")
    sign = F.when(F.col("coefficient") > 0, "positive").when(F.col("coefficient") < 0, "negative")
    return frame.withColumn("direction", sign.otherwise("neutral"))
