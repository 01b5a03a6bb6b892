"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the cumulative target shares and give every
slot of the mix a source; a slot's rank within its source names the block it
takes. Each source's documents, in hashed order, form a stream that is cut
into blocks of equal size and repeated once. A source takes as many blocks
as its target holds, the last one in part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.llm._stage import stage
from gridpulse.llm._stats import free_name
from gridpulse.llm._text import slices, spans

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK = 1024
#: Sources of one mix: their targets are a configuration, held by the driver and by every task.
MOST_SOURCES = 100_000
#: Documents of a source that are ordered in one task, on average.
RUN_DOCS = 50_000
SLOTS_PER_TASK = 1 << 20
GOLDEN = (math.sqrt(5) - 1) / 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [spans(data, bounds)[2] for _, _, data, bounds in slices(batch.column("text"))]
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), batch.column("row_hash"), pa.array(size)],
            ["doc_id", "source", "row_hash", "size"],
        )


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = EPOCHS) -> list[float]:
    """Target of each source: a weighted part of ``share`` of all, at most ``most`` times its size.

    What a stopped source would have had above its bound is shared by weight
    among the others, again until none is above.
    """
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    bound = [most * s for s in sizes]
    stopped: set[int] = set()
    while True:
        left = share * sum(sizes) - sum(bound[k] for k in stopped)
        open_ = sum(w for k, w in enumerate(weight) if k not in stopped)
        level = left / open_ if open_ else 0.0
        over = {k for k, w in enumerate(weight) if k not in stopped and level * w > bound[k]}
        if not over:
            return [float(bound[k]) if k in stopped else level * w for k, w in enumerate(weight)]
        stopped |= over


def _slots(batches: Iterator[pa.RecordBatch], cumulative: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, source_no, slot) of slot numbers: the source whose share holds the slot's point."""
    for batch in batches:
        slot = batch.column("id").to_numpy()
        # the fraction of slot * GOLDEN in 64-bit integers, exact for any slot
        point = (slot.astype(np.uint64) * np.uint64(int(GOLDEN * 2**64))) / 2.0**64
        no = np.minimum(np.searchsorted(cumulative, point, "right"), len(cumulative) - 1)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(slot // SLOTS_PER_TASK), "source_no": pa.array(no.astype(np.int64)), "slot": pa.array(slot)}
        )


def schedule(spark: SparkSession, goals: list[int], block: int = BLOCK) -> DataFrame:
    """(source_no, block_no, slot): the slot in which each source takes each of its blocks.

    Source k takes ceil(goals[k] / block) blocks. Ranks are counted in two
    steps, by part of the schedule and within it, so that no source's slots
    meet in one task. A source whose points fall short of its blocks by the
    discrepancy takes the rest after the last slot.
    """
    total = sum(goals)
    wanted = [math.ceil(g / block) for g in goals]
    slots = math.ceil(total / block)
    cumulative = np.cumsum(np.array(goals, float)) / max(total, 1)
    parts = max(1, math.ceil(slots / SLOTS_PER_TASK))
    points = spark.range(0, slots, 1, parts).mapInArrow(
        lambda it: _slots(it, cumulative), "part long, source_no long, slot long"
    )
    points = stage(points, "mixing")
    before = (
        points.groupBy("source_no", "part").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("source_no", "part", F.coalesce("before", F.lit(0)).alias("before"), "n")
    )
    before = stage(before, "mixing")
    need = spark.createDataFrame([(k, w) for k, w in enumerate(wanted)], "source_no long, wanted long")
    within = Window.partitionBy("source_no", "part").orderBy("slot")
    ranked = (
        points.withColumn("rank", F.row_number().over(within) - 1)
        .join(before, ["source_no", "part"])
        .select("source_no", (F.col("before") + F.col("rank")).alias("block_no"), "slot")
    )
    have = before.groupBy("source_no").agg(F.sum("n").alias("have"))
    short = need.join(have, "source_no", "left").where("wanted > coalesce(have, 0)")
    rest = short.select("source_no", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("wanted") - 1)).alias("block_no"))
    rest = rest.withColumn("slot", F.lit(slots) + F.col("block_no"))
    return ranked.unionByName(rest).join(need, "source_no").where("block_no < wanted").drop("wanted")


def _row_hash(documents: DataFrame) -> Column:
    """Hash of the columns a row is known by; others may be of any type."""
    return F.xxhash64(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in documents.columns])


def _placed(documents: DataFrame, block: int) -> tuple[DataFrame, list, list[int]]:
    """Documents with their place in the stream of their source, the sources, their goals in words."""
    spark = documents.sparkSession
    sized = stage(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"),
            _row_hash(documents).alias("row_hash"),
        ).mapInArrow(_count, "doc_id long, source string, row_hash long, size long"),
        "mixing",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; name the mix's sources first")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wishes = targets([r["size"] for r in found])
    goals = [min(round(t), EPOCHS * r["size"]) for t, r in zip(wishes, found)]
    names = spark.createDataFrame(
        [(k, r["source"], r["size"], t, g) for k, (r, t, g) in enumerate(zip(found, wishes, goals))],
        "source_no long, source string, source_size long, target double, goal long",
    )
    # the list is held by the driver already and bounded by MOST_SOURCES
    known = F.broadcast(names)
    runs = max(1, math.ceil(sum(r["n"] for r in found) / RUN_DOCS))
    order = F.xxhash64(F.lit(9), "row_hash")
    dealt = stage(
        sized.join(known, sized["source"].eqNullSafe(names["source"])).drop(names["source"])
        .withColumn("order", order)
        .withColumn("run", F.floor((F.shiftright("order", 32) + F.lit(1 << 31)) * runs / F.lit(1 << 32))),
        "mixing",
    )
    sums = (
        dealt.groupBy("source_no", "run").agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
        .select("source_no", "run", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("source_no", "run").orderBy("order", "row_hash", "doc_id")
    placed = (
        dealt.withColumn("inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("copy", F.row_number().over(within))
        .join(stage(sums, "mixing"), ["source_no", "run"])
        .withColumn("begin", F.col("before") + F.col("inner"))
        .drop("inner", "before", "order")
    )
    return stage(placed, "mixing"), found, goals


def _pieces(placed: DataFrame, goals: list[int], block: int) -> DataFrame:
    """(source_no, begin, epoch, slot, words): what each block that is taken takes of each document."""
    spark = placed.sparkSession
    epochs = placed.where("size > 0").select(
        "source_no", "begin", "size", "goal",
        F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])).alias("epoch"), "source_size",
    )
    at = F.col("begin") + F.col("epoch") * F.col("source_size")
    taken = epochs.withColumn("at", at).where("at < goal").withColumn("end", F.least(F.col("at") + F.col("size"), "goal"))
    spread = taken.select(
        "source_no", "begin", "epoch", "at", "end",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))).alias("block_no"),
    )
    return spread.join(schedule(spark, goals, block), ["source_no", "block_no"]).select(
        "source_no", "begin", "epoch", "slot",
        (F.least("end", (F.col("block_no") + 1) * block) - F.greatest("at", F.col("block_no") * block)).alias("words"),
    )


def mix_sources(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Sources in order of code point, null last, weigh 3, 1, 2, repeating.
    Every source takes its target, rounded to words, and no document more
    than twice. The order depends on the rows alone, so reruns agree; rows
    that are equal throughout are taken one after the other. Null and
    wordless texts have size 0 and are never taken. Repeated rows and rows
    without doc_id count like any others. Further columns but lang and
    n_chars are not read. An empty table gives no rows.
    """
    placed, _, goals = _placed(documents, block)
    taken = _pieces(placed, goals, block).groupBy("source_no", "begin").agg(F.sum("words").alias("words"))
    # documents of size 0 share the begin of the one after them
    key = F.when(F.col("size") > 0, F.col("begin"))
    joined = placed.withColumn("key", key).join(
        taken.withColumnRenamed("begin", "key"), ["source_no", "key"], "left"
    )
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))


def mixed_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: one row per document and pass, with the columns of ``documents``.

    A document that the mix takes once or twice appears so often, always
    whole: the one in which a source's target ends is there if the target
    holds half of it or if it is the source's first, so a source's words
    come within half a document of its target. Rows lie in the order of their
    first slot. Rows equal throughout give all their passes. Null and
    wordless texts are never there; an empty table gives no rows.
    """
    placed, _, goals = _placed(documents, block)
    passes = (
        _pieces(placed, goals, block).groupBy("source_no", "begin", "epoch")
        .agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    )
    known_rows = placed.where("size > 0").select("source_no", "begin", "doc_id", "row_hash", "size")
    listed = (
        passes.join(known_rows, ["source_no", "begin"])
        .where("2 * words >= size or begin = 0 and epoch = 0")
        .groupBy(F.col("doc_id").alias("listed_id"), F.col("row_hash").alias("listed_hash"))
        .agg(F.collect_list(F.struct("slot", "epoch")).alias("passes"))
    )
    columns = documents.columns
    names = [free_name(documents, n) for n in ("mix_key", "mix_hash", "mix_pass")]
    key, known, taken = names
    hashed = documents.withColumns({key: F.col("doc_id").cast("long"), known: _row_hash(documents)})
    same = F.col(key).eqNullSafe(F.col("listed_id")) & (F.col(known) == F.col("listed_hash"))
    repeats = stage(
        placed.where("size > 0").groupBy(F.col("doc_id").alias("listed_id"), F.col("row_hash").alias("listed_hash"))
        .agg(F.count("*").alias("n")).where("n > 1").drop("n"),
        "mixing",
    )
    if not repeats.isEmpty():  # of equal rows one is kept, which gives the passes of all
        again = broadcast_if_small(repeats)
        one = hashed.join(again, same, "left_semi").dropDuplicates([key, known])
        hashed = hashed.join(again, same, "left_anti").unionByName(one)
    joined = hashed.join(listed.hint("shuffle_hash"), same).withColumn(taken, F.explode("passes"))
    return joined.sortWithinPartitions(f"{taken}.slot").select(*columns)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
