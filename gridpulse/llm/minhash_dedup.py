"""Near-duplicate documents by SuperMinHash signatures.

Every distinct shingle runs through a permutation of the signature slots; the
rank at which it reaches a slot, plus a random fraction, competes for the
slot's minimum. One permutation serves all slots, so ranks are correlated and
signatures vary less than those of independent hashes; a document stops as
soon as no later rank can improve a slot. Bands of slots give candidates,
full shingle sets decide, and confirmed links are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.llm._stage import components, stage
from gridpulse.llm._stats import free_name
from gridpulse.llm._text import mix, slices, windows, words

WORDS = 5
BANDS, ROWS = 28, 4
SLOTS = BANDS * ROWS
#: Candidates whose signatures agree in a smaller share of slots than this are not
#: compared again: more than four deviations (0.041) below the least similarity of a link.
LEAST_AGREEMENT = 0.58
#: Members of a block; a task compares one pair of blocks of a bucket. In buckets of more than MOST_BLOCKS
#: a component of more than BUCKET members has blocks of its own, which are not compared with each other.
BUCKET, MOST_BLOCKS = 1024, 16


def shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles of one document's word hashes, the whole sequence if it is shorter."""
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        return windows(hashes, len(hashes))
    return np.unique(windows(hashes, size))


def signatures(items: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of every document: 32-bit ranks with fraction, one row each.

    ``items`` holds the documents' distinct shingles one after another. All
    documents move through the ranks together; those whose slots are all
    below the next rank drop out. Values are rank * 2^24 + 24 random bits.
    """
    n = len(counts)
    sig = np.full(n * slots, 0xFFFFFFFF, np.uint32)
    doc = np.repeat(np.arange(n), counts)
    order = None  # permutation of each live item, made when first needed
    first = None
    for rank in range(slots):
        if not len(items):
            break
        bits = mix(items + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = rank + ((bits >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        value = np.uint32(rank << 24) + (bits & np.uint64(0xFFFFFF)).astype(np.uint32)
        if rank == 0:
            slot = first = pick
        else:
            rows = np.arange(len(items))
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
                order[rows, 0], order[rows, first] = first, 0
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, rank]
            order[rows, rank] = slot
        np.minimum.at(sig, doc * slots + slot, value)
        worst = sig.reshape(n, slots).max(axis=1)
        live = (worst >= np.uint32(min(rank + 1, 255) << 24))[doc]
        items, doc = items[live], doc[live]
        first = first[live] if order is None else None
        order = order[live] if order is not None else None
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C55) + parts[:, :, k])
    return key


def _per_document(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingles, their number by row)."""
    for first, end, data, bounds in slices(column):
        hashes, counts = words(data, bounds)
        ends = np.cumsum(counts)
        sets = [shingles(hashes[b - c : b], size) for b, c in zip(ends, counts)]
        yield first, end, np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, items, counts in _per_document(batch.column("text"), size):
            starts = np.cumsum(counts) - counts
            padded = np.append(items, np.uint64(0))
            prints = [
                np.where(counts > 0, np.add.reduceat(mix(padded ^ np.uint64(seed)), starts), 0)
                for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)
            ]
            sig = signatures(items, counts)
            keys = band_keys(sig).view(np.int64).ravel()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id")[first:end],
                    "n_shingles": pa.array(counts),
                    "print1": pa.array(prints[0].astype(np.uint64).view(np.int64)),
                    "print2": pa.array(prints[1].astype(np.uint64).view(np.int64)),
                    "bands": pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), keys),
                    "slots": pa.array([row.tobytes() for row in mix(sig.astype(np.uint64)).astype(np.uint8)], pa.binary()),
                }
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, items, counts in _per_document(batch.column("text"), size):
            bounds = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id")[first:end],
                    "items": pa.ListArray.from_arrays(bounds, items.view(np.int64)),
                }
            )


def _united(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links between components that meet in a bucket, enough of them to unite these.

    Rows come sorted by bucket; the last bucket of a batch waits for the
    next one. A pair is looked at in the first band that it shares, unless
    earlier links of the bucket have united it already.
    """
    kept: list[pa.Table] = []

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table["bucket"].to_numpy()
        edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ids, comp, side, band = (table[c].to_numpy() for c in ("rep", "component", "side", "band"))
        sig = np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint8).reshape(-1, SLOTS)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        items = table["items"].combine_chunks()
        size = items.value_lengths().to_numpy().astype(np.int64)
        flat, at = items.flatten().to_numpy(), np.append(0, np.cumsum(size))
        pairs = []
        for low, high in zip(edges, np.append(edges[1:], len(keys))):
            group = comp[low:high].copy()
            for x in range(low, high - 1):
                later = np.flatnonzero(group[x + 1 - low :] != group[x - low]) + x + 1
                later = later[np.minimum(size[later], size[x]) * 100 >= np.maximum(size[later], size[x]) * least]
                later = later[(side[later] != side[x]) | (side[x] == 2)]
                if not len(later):
                    continue
                agree = (sig[later] == sig[x]).mean(axis=1)
                same = bands[later, : band[x]] == bands[x, : band[x]]
                later = later[(agree >= LEAST_AGREEMENT) & ~same.any(axis=1)]
                own = np.sort(flat[at[x] : at[x + 1]])
                for part in np.split(later, range(64, len(later), 64)):
                    part = part[group[part - low] != group[x - low]]
                    if not len(part):
                        continue
                    other = np.concatenate([flat[at[k] : at[k + 1]] for k in part])
                    found = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                    both = np.add.reduceat(found, np.cumsum(size[part]) - size[part], dtype=np.int64)
                    for y in part[100 * both >= least * (size[part] + size[x] - both)]:
                        if group[y - low] != group[x - low]:
                            pairs.append((ids[x], ids[y], comp[x], comp[y]))
                            group[group == group[y - low]] = group[x - low]
        if pairs:
            columns = [pa.array(c, pa.int64()) for c in zip(*pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "component_a", "component_b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*kept, pa.Table.from_batches([batch])])
        keys = table["bucket"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield from links(table.slice(0, cut))
        kept = [table.slice(cut)]
    if kept:
        yield from links(kept[0])


def _sets_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, items): full shingle sets of the documents in ``ids`` (doc_id, staged)."""
    texts = documents.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    return stage(texts.mapInArrow(lambda it: _sets(it, WORDS), "doc_id long, items array<long>"), "minhash")


def _confirmed(documents: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b, staged) that are links on their full sets."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "minhash")
    sets = _sets_of(documents, ids)
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(100 * both >= least * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_duplicates(documents: DataFrame, least: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``100 * intersection >= least * union`` of their
    sets of five-word shingles (``least`` of 75 or more keeps the banding's
    recall above 0.9999). Documents with the same set are one class, held by
    its smallest doc_id. Candidates are taken in steps: every member of
    a bucket against the bucket's first; then, in buckets that still hold
    several components, all the pairs between these whose signatures agree.

    Null or wordless texts have no shingles and are linked with nothing.
    Rows with a null doc_id are linked with nothing and kept (component_id
    null). Rows that repeat a doc_id share its component; if their texts
    differ, all take part in the first step and one of them in the second.
    Columns other than doc_id and text are not read. An empty table gives no
    rows.
    """
    signed = stage(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            lambda it: _sign(it, WORDS),
            "doc_id long, n_shingles long, print1 long, print2 long, bands array<long>, slots binary",
        ),
        "minhash",
    )
    prints = ["n_shingles", "print1", "print2"]
    # bands and slots are the same throughout a class; a repeated doc_id with several texts can stand for several classes
    classes = stage(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("slots").alias("slots")),
        "minhash",
    )
    repeated = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("doc_id").agg(F.min("print1").alias("low"), F.max("print1").alias("high")).where("low <> high")
    )
    same_id = (
        signed.join(repeated.select("doc_id"), "doc_id").join(classes.select("rep", *prints), prints)
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    member = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    hubs = stage(
        member.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("rep", "n_shingles")).alias("hub")).where("n > 1"),
        "minhash",
    )
    stars = stage(
        member.join(hubs, "bucket")
        .where("rep <> hub.rep and least(n_shingles, hub.n_shingles) * 100 >= greatest(n_shingles, hub.n_shingles) * " + str(least))
        .select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct(),
        "minhash",
    )
    group = components(_confirmed(documents, stars, least).unionByName(same_id))
    placed = stage(
        classes.join(group, classes["rep"] == group["node"], "left")
        .select(*prints, "rep", "slots", "bands", F.coalesce("component", "rep").alias("component")),
        "minhash",
    )
    homes = placed.select(*prints, "component")
    more = _more_links(documents, placed, least, "component_a", "component_b")
    if not more.isEmpty():
        # components by their smallest doc_id, which are fewer than documents
        united = components(more.toDF("a", "b")).toDF("node", "united")
        homes = stage(
            homes.join(united, homes["component"] == united["node"], "left")
            .select(*prints, F.coalesce("united", "component").alias("component")),
            "minhash",
        )
    found = signed.select("doc_id", *prints).join(homes, prints, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def _shared_buckets(placed: DataFrame) -> DataFrame:
    """(rep, bucket, band, side) of the buckets that hold several components.

    Buckets of more than BUCKET members are compared block by block, each
    pair of blocks being a group of its own, so that no task holds an
    unbounded group. All pairs of different components of a bucket meet,
    whatever its size; the blocks of one large component are left unpaired.
    """
    member = placed.select("rep", "component", F.posexplode("bands").alias("band", "bucket"))
    state = [F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")]
    blocks = F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks")
    open_ = stage(member.groupBy("bucket").agg(*state).where("low <> high").select("bucket", blocks), "minhash")
    block = F.pmod(F.xxhash64("rep"), F.col("many")).cast("int") + F.col("first")
    small = member.join(open_.where(f"blocks <= {MOST_BLOCKS}"), "bucket").select(
        "rep", "bucket", "band", F.lit(False).alias("own"), F.lit(0).alias("first"), F.col("blocks").alias("many"), "blocks"
    )
    large = member.join(open_.where(f"blocks > {MOST_BLOCKS}").select("bucket"), "bucket")
    large_components = (
        large.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        .withColumn("own", F.col("n") > BUCKET)
        .withColumn("owner", F.when(F.col("own"), F.col("component")))
    )
    large_components = stage(large_components, "minhash")
    # one row per large component of a bucket and one for all others, far fewer than its members
    of_bucket = Window.partitionBy("bucket")
    owners = (
        large_components.groupBy("bucket", "owner").agg(F.ceil(F.sum("n") / BUCKET).cast("int").alias("many"))
        .withColumn("upto", F.sum("many").over(of_bucket.orderBy("owner").rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            F.col("bucket").alias("in_bucket"), F.col("owner").alias("of_owner"), "many",
            (F.col("upto") - F.col("many")).cast("int").alias("first"), F.sum("many").over(of_bucket).cast("int").alias("blocks"),
        )
    )
    homes = stage(
        large_components.join(owners, (F.col("bucket") == F.col("in_bucket")) & F.col("owner").eqNullSafe(F.col("of_owner")))
        .select("bucket", "component", "own", "first", "many", "blocks"),
        "minhash",
    )
    rows = small.unionByName(
        large.join(homes, ["bucket", "component"]).select("rep", "bucket", "band", "own", "first", "many", "blocks")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return stage(
        rows.select("rep", "bucket", "band", "own", "first", "many", block.alias("block"), other.alias("other"))
        .where("not own or other < first or other >= first + many")
        .select(
            "rep", "band",
            F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"),
            # 2: a block against itself; else the pairs of different blocks only
            F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        ),
        "minhash",
    )


def _more_links(documents: DataFrame, placed: DataFrame, least: int, *ends: str) -> DataFrame:
    """Links (a, b) between components that share buckets, confirmed on full sets.

    ``ends`` names other columns instead: component_a, component_b.
    """
    shared = _shared_buckets(placed)
    ids = stage(shared.select(F.col("rep").alias("doc_id")).distinct(), "minhash")
    sets = _sets_of(documents, ids).withColumnRenamed("doc_id", "rep")
    known = placed.select("rep", "component", "slots", "bands").join(sets.dropDuplicates(["rep"]), "rep")
    full = shared.join(known, "rep").repartition("bucket").sortWithinPartitions("bucket")
    found = full.mapInArrow(lambda it: _united(it, least), "a long, b long, component_a long, component_b long")
    return stage(found.select(*(ends or ("a", "b"))).distinct(), "minhash")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: one document of each group, rows without doc_id all.

    Of rows that repeat a kept doc_id one stays.
    """
    found = near_duplicates(documents)
    keep = stage(
        found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")), "minhash"
    )
    name = free_name(documents, "kept_id")
    ids = keep.where("n = 1").select(F.col("doc_id").alias(name))
    same = F.col("doc_id").cast("long") == F.col(name)
    out = documents.join(broadcast_if_small(ids), same, "left_semi")
    parts = [out, documents.where("doc_id is null")]
    repeated = keep.where("n > 1")
    if not repeated.isEmpty():
        again = documents.join(broadcast_if_small(repeated.select(F.col("doc_id").alias(name))), same, "left_semi")
        parts.append(again.dropDuplicates(["doc_id"]))
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    return parts[0]


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORD = r"[^\x20\x09-\x0D]+"

#: The definition: all pairs by shared shingle, components by reachability.
ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {WORDS} THEN w ELSE w[i : i + {WORDS - 1}] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a AS doc_id, a AS node FROM ways UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.node),
groups AS (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN groups USING (doc_id)
"""
