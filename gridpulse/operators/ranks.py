"""Exact order statistics and rank metrics without gathering a group in one task.

A group (a class label, or the whole table) may hold most of the rows, so
neither a window over it nor ``percentile`` (which keeps every distinct value
of a group in one buffer) is safe. A mergeable sketch of each group encloses
the wanted ranks in brackets of a few thousandths of its values; one more pass
counts what lies below, and value by value only inside. Both passes combine
before they are shuffled, and hot values count as one row each. Rank metrics
count per *segment*, a monotone bucket of the value, and per *cell*, one of
1,024 parts of a segment. The results are exact.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.sources.sinks import stage_table

_LEVELS_PER_OCTAVE = 64
_CELLS = 1024
_RESOLUTION = 1024.0
#: Values a sketch keeps about, and four times its rank error (2.296 / k**0.9723 of the values at 99 %);
#: steps of the ranks read from it.
SKETCH_SIZE, GRID = 4096, 1000
MARGIN = 4 * 2.296 / SKETCH_SIZE**0.9723


def cell(value: Column) -> Column:
    """Monotone bucket: 1,024 for each segment."""
    magnitude = F.log2(1.0 + F.abs(value) * _RESOLUTION) * (_LEVELS_PER_OCTAVE * _CELLS)
    return F.floor(F.signum(value) * magnitude).cast("long")


def segment(value: Column) -> Column:
    """Monotone bucket: 64 per doubling of the magnitude, finer steps near 0.

    At most about 64 * 2 * 1034 buckets exist over the whole double range.
    """
    return F.floor(cell(value) / _CELLS).cast("long")


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]
) -> DataFrame:
    """The k-th smallest ``value`` per group, for several k.

    ``ranks`` maps an output column to its 1-based rank, an expression over the
    group size ``n``. NULL and NaN values are ignored. Output: keys, n, one
    column per rank; a group without values has no row.

    Two passes: the first sketches every group, now; the second, when the
    result is read, counts the values inside the brackets one by one and those
    between two brackets as one, so a bracket's place is exact. A rank that
    fell outside its bracket would raise.
    """
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    brackets, low, high = _bracketed(base, keys, ranks)
    inside = reduce(or_, [F.col("_v").between(a, b) for a, b in zip(low, high)])
    below = F.greatest(*[F.when(F.col("_v") > b, b) for b in high], F.lit(None).cast("double"))
    joined = base
    if brackets is not None:
        joined = base.join(broadcast_if_small(brackets), keys)
    counted = (
        joined.select(*keys, F.when(inside, F.col("_v")).otherwise(below).alias("_level"), (~inside).alias("_between"))
        .groupBy(*keys, "_level", "_between").agg(F.count("*").alias("_c"))
    )
    per_group = Window.partitionBy(*(keys or [F.lit(0)]))
    running = counted.select(
        *keys, "_level", "_between", "_c", F.sum("_c").over(per_group).alias("n"),
        F.sum("_c").over(per_group.orderBy("_level", "_between")).alias("_upto"),
    )
    picked = []
    for name, rank in ranks.items():
        k = rank.cast("long")
        here = (k > F.col("_upto") - F.col("_c")) & (k <= F.col("_upto"))
        lost = F.raise_error(F.lit(f"rank {name} outside its bracket")).cast("double")
        picked.append(F.max(F.when(here, F.when(F.col("_between"), lost).otherwise(F.col("_level")))).alias(name))
    return running.groupBy(*keys).agg(F.first("n").alias("n"), *picked).filter("n is not null")


def _bracketed(
    base: DataFrame, keys: list[str], ranks: dict[str, Column]
) -> tuple[DataFrame | None, list[Column], list[Column]]:
    """Values that enclose every rank, from one sketch per group.

    Without keys the brackets are literals; else they are columns of a stored
    frame to be joined.
    """
    sketched = base.groupBy(*keys).agg(
        F.kll_sketch_agg_double("_v", F.lit(SKETCH_SIZE)).alias("_sketch"), F.count("*").alias("n")
    )

    def edge(rank: Column, side: int) -> Column:
        share = ((rank - 0.5) / F.col("n") + F.lit(side * MARGIN)) * GRID
        step = (F.floor(share) if side < 0 else F.ceil(share)).cast("int")
        found = F.get("_grid", step)
        return F.when((step <= 0) | (step >= GRID), F.lit(side * float("inf"))).otherwise(found)

    names = [(f"_low{i}", f"_high{i}") for i in range(len(ranks))]
    edges = [
        c for (low, high), rank in zip(names, ranks.values()) for c in (edge(rank, -1).alias(low), edge(rank, 1).alias(high))
    ]
    grid = F.expr(f"array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})")
    quantiles = sketched.filter("n > 0").withColumn("_grid", F.kll_sketch_get_quantile_double("_sketch", grid))
    frame = quantiles.select(*keys, *edges)
    if keys:
        return stage_table(frame, "brackets"), [F.col(a) for a, _ in names], [F.col(b) for _, b in names]
    row = frame.first()
    if row is None:
        row = dict.fromkeys([x for pair in names for x in pair], 0.0)
    return None, [F.lit(row[a]) for a, _ in names], [F.lit(row[b]) for _, b in names]


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Percentiles with linear interpolation between the two neighbouring ranks."""
    n = F.col("n")
    ranks: dict[str, Column] = {}
    for name, p in probs.items():
        position = F.lit(p) * (n - 1)
        ranks[f"{name}_lo"] = F.floor(position) + 1
        ranks[f"{name}_hi"] = F.ceil(position) + 1
    stats = order_statistics(df, keys, value, ranks)
    out = []
    for name, p in probs.items():
        position = F.lit(p) * (n - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return stats.select(*keys, "n", *out)


def score_levels(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with their positives and negatives and the totals above each.

    Running totals are taken inside a cell and offset by the totals of the
    higher cells of its segment and of the higher segments, so no ordering runs
    over all scores at once; only the segment table (bounded, see ``segment``)
    is ordered as a whole. The levels are stored, as three steps read them.
    """
    levels = stage_table(
        df.groupBy(F.col(score).alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
        )
        .withColumn("seg", segment(F.col("score")))
        .withColumn("cell", cell(F.col("score"))),
        "levels",
    )

    def above(totals: DataFrame, window: WindowSpec, name: str) -> DataFrame:
        return totals.select(
            "*",
            (F.sum("pos").over(window) - F.col("pos")).alias(f"pos_{name}"),
            (F.sum("neg").over(window) - F.col("neg")).alias(f"neg_{name}"),
        ).drop("pos", "neg")

    sums = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    in_segment = Window.partitionBy("seg").orderBy(F.desc("cell"))
    cells = above(levels.groupBy("seg", "cell").agg(*sums), in_segment, "cell")
    segments = above(levels.groupBy("seg").agg(*sums), Window.orderBy(F.desc("seg")), "seg")
    inside = Window.partitionBy("cell").orderBy(F.desc("score"))
    return (
        levels.withColumn("run_pos", F.sum("pos").over(inside))
        .withColumn("run_neg", F.sum("neg").over(inside))
        .join(cells.drop("seg"), "cell")
        .join(broadcast_if_small(segments), "seg")
        .select(
            "score",
            "pos",
            "neg",
            (F.col("pos_seg") + F.col("pos_cell") + F.col("run_pos")).alias("pos_upto"),
            (F.col("neg_seg") + F.col("neg_cell") + F.col("run_neg")).alias("neg_upto"),
        )
    )


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: ROC-AUC and average precision (step-wise, not the trapezoid)."""
    levels = score_levels(df, score, label)
    better = F.col("neg_upto") - F.col("neg")
    worse_pairs = F.col("pos") * (better + F.col("neg") / 2.0)
    precision = F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    stats = levels.agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("q"),
        F.sum(worse_pairs).alias("lost"),
        F.sum(F.col("pos") * precision).alias("ap"),
    )
    pairs = F.col("p") * F.col("q")
    return stats.select(
        F.col("p").alias("positives"),
        F.col("q").alias("negatives"),
        (1.0 - F.try_divide(F.col("lost"), pairs.cast("double"))).alias("roc_auc"),
        F.try_divide(F.col("ap"), F.col("p").cast("double")).alias("average_precision"),
    )
