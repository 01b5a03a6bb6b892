"""Order statistics and rank metrics against brute force, with hot groups."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpulse.operators import ranks


def skewed(seed: int, n: int = 3000):
    """One group holds most rows; values repeat, span magnitudes and signs."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        key = 0 if rng.random() < 0.8 else rng.randrange(1, 5)
        kind = rng.random()
        if kind < 0.3:
            v = 0.0
        elif kind < 0.6:
            v = float(rng.randrange(-3, 4))
        else:
            v = rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 12)
        rows.append((key, v if rng.random() > 0.02 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_match_numpy(spark, seed):
    rows = skewed(seed)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r for r in ranks.exact_percentiles(df, ["k"], "v", probs).collect()}
    frame = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    for k, group in frame.groupby("k"):
        assert got[k]["n"] == len(group)
        for name, p in probs.items():
            want = np.quantile(group["v"], p)
            assert got[k][name] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_percentile_of_whole_table(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 12)], "v double")
    row = ranks.exact_percentiles(df, [], "v", {"p10": 0.1}).first()
    assert row["p10"] == pytest.approx(2.0)


def test_order_statistics_rank_expressions(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 1.0, 9.0)], "v double")
    out = ranks.order_statistics(df, [], "v", {"first": F.lit(1), "last": F.col("n")}).first()
    assert (out["first"], out["last"], out["n"]) == (1.0, 9.0, 4)


def test_segment_is_monotone_and_bounded(spark):
    values = sorted(
        [s * 10.0**e for e in range(-300, 300, 7) for s in (-1, 1)] + [0.0, 1.0, 1.5]
    )
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    segs = [r["s"] for r in df.select("i", ranks.segment(F.col("v")).alias("s")).orderBy("i").collect()]
    assert segs == sorted(segs)
    assert max(map(abs, segs)) < 64 * 1100


@pytest.mark.parametrize("levels", [3, 1000])
def test_ranking_metrics_match_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.randrange(levels) / levels, int(rng.random() < 0.2)) for _ in range(400)]
    got = ranks.ranking_metrics(
        spark.createDataFrame(rows, "s double, y int"), "s", "y"
    ).first()
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert got["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    precision_sum, recall_before = 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(y for s, y in rows if s >= t)
        precision = tp / sum(s >= t for s, _ in rows)
        recall = tp / len(pos)
        precision_sum += (recall - recall_before) * precision
        recall_before = recall
    assert got["average_precision"] == pytest.approx(precision_sum)


def test_ranking_metrics_one_class(spark):
    got = ranks.ranking_metrics(spark.createDataFrame([(0.5, 0)], "s double, y int"), "s", "y")
    assert got.first()["roc_auc"] is None


def test_close_scores_spread_over_cells(spark):
    df = spark.range(200_000).select((0.01 + F.rand(7) * 0.02).alias("v"))
    sizes = df.groupBy(ranks.cell(F.col("v"))).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[1] > 50_000 and sizes[0] < 40
    out = ranks.exact_percentiles(df, [], "v", {"p50": 0.5}).first()
    assert out["n"] == 200_000 and abs(out["p50"] - 0.02) < 0.001


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_brackets_of_more_values_than_a_sketch_keeps(spark, hot):
    """60,000 values: ties, a value with 40 % of the rows, several ranks in one bracket."""
    rng = np.random.default_rng(7)
    values = np.where(rng.random(60_000) < hot, 7.25, np.round(rng.lognormal(2, 1.5, 60_000), 2))
    keys = (rng.random(60_000) < 0.95).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": values})).repartition(6)
    probs = {"p1": 0.01, "p10": 0.1, "p10b": 0.1003, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for by in ([], ["k"]):
        got = ranks.exact_percentiles(df, by, "v", probs).collect()
        for row in got:
            group = values[keys == row["k"]] if by else values
            assert row["n"] == len(group)
            for name, p in probs.items():
                assert row[name] == pytest.approx(np.quantile(group, p), rel=1e-12)
        assert len(got) == (2 if by else 1)


def test_a_rank_outside_its_bracket_raises(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MARGIN", -0.2)
    df = spark.range(50_000).select(F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="outside its bracket"):
        ranks.exact_percentiles(df, [], "v", {"p50": 0.5}).collect()


def test_groups_without_values_have_no_percentile(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, float("nan"))], "k int, v double")
    assert [tuple(r) for r in ranks.exact_percentiles(df, ["k"], "v", {"p": 0.5}).collect()] == [(2, 1, 3.0)]
    assert ranks.exact_percentiles(df.filter("v > 9 and not isnan(v)"), [], "v", {"p": 0.5}).collect() == []
