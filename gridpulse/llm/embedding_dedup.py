"""Near-duplicate embeddings with one navigable small-world graph per shard.

Distinct vectors are dealt to shards; every shard is one hierarchical graph,
which a task writes as files to the shared folder. Every vector queries every
shard: a task reads a block of a shard's vectors and the graph of one shard, so
rows carry paths and no graph is shuffled or copied. A shard's beam is widened until an audit
passes on known links of a sample; a query whose beam is full of links is
compared with the whole shard. Candidates are confirmed by cosine in double precision.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.llm._stage import components, file_store, folder, stage
from gridpulse.llm._text import mix

THRESHOLD = 0.95
LINKS = 12
BUILD_BEAM = 40
FIRST_BEAM, WIDEST_BEAM = 24, 256
#: Cosines held at once where queries are compared with a whole shard, and members marked as seen.
PRODUCT = 1 << 22
#: Queries that walk a graph side by side, and nodes that join it in a batch, at most.
SIDE_BY_SIDE = 256
#: Components of a shard's vectors, on average, and of a block of queries, at most (50,000 and
#: 25,000 vectors of 64); there are LEAST_SHARDS shards at least.
SHARD_SIZE, BLOCK_SIZE, LEAST_SHARDS = 3_200_000, 1_600_000, 4
AUDITS, LEAST_RECALL = 200, 0.99
#: Tasks that compare blocks with shards, at most; each takes one pair after the other.
MOST_TASKS = 10_000


class Graph:
    """Hierarchical navigable small world over unit vectors; layer 0 has twice the links.

    A layer is its nodes, the row of each node (-1: not in it) and a matrix of links, -1 where a row
    has fewer. Queries walk side by side, as many as SIDE_BY_SIDE and PRODUCT allow.
    """

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], entry: int, beam: int):
        self.vectors, self.layers, self.entry, self.beam = vectors, [], entry, beam
        for nodes, links in layers:
            row = np.full(len(vectors), -1, np.int32)
            row[nodes] = np.arange(len(nodes))
            self.layers.append((nodes, row, links))
        self.side = max(1, min(SIDE_BY_SIDE, PRODUCT // len(vectors)))
        self.seen = np.zeros(self.side * len(vectors), np.int32)
        self.turn = 1

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray) -> Graph:
        """Nodes join in batches; those of a batch know the ones before them from one matrix product."""
        u = (mix(ids.astype(np.uint64) + np.uint64(7)) >> np.uint64(11)) / 2.0**53
        levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(LINKS)).astype(int), 8)
        layers = []
        for k in range(int(levels.max()) + 1):
            nodes = np.flatnonzero(levels >= k)
            layers.append((nodes, np.full((len(nodes), LINKS * (2 if k == 0 else 1)), -1, np.int32)))
        graph = cls(vectors, layers, 0, FIRST_BEAM)
        top = -1
        for first in range(0, len(vectors), graph.side):
            batch = np.arange(first, min(first + graph.side, len(vectors)))
            own = vectors[batch] @ vectors[batch].T
            own[np.triu_indices(len(batch))] = -np.inf
            start = np.full((len(batch), 1), graph.entry)
            for k in range(len(layers) - 1, -1, -1):
                joins = np.flatnonzero(levels[batch] >= k)
                found = np.full((len(batch), BUILD_BEAM), -1)
                sims = np.full((len(batch), BUILD_BEAM), -np.inf, np.float32)
                if k <= top:
                    for rows, beam in ((joins, BUILD_BEAM), (np.flatnonzero(levels[batch] < k), 1)):
                        if len(rows):
                            found[rows, :beam], sims[rows, :beam] = graph._walk(vectors[batch[rows]], start[rows], beam, k)
                    start = found
                if len(joins):
                    known = np.concatenate([found[joins], np.broadcast_to(batch[joins], (len(joins), len(joins)))], axis=1)
                    near = np.concatenate([sims[joins], own[np.ix_(joins, joins)]], axis=1)
                    order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
                    graph._join(batch[joins], np.take_along_axis(known, order, 1), np.take_along_axis(near, order, 1), k)
            if int(levels[batch].max()) > top:
                top = int(levels[batch].max())
                graph.entry = int(batch[levels[batch].argmax()])
        return graph

    def _walk(self, queries: np.ndarray, start: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest found of each query and their cosines, best first (-1 and -inf where there are fewer).

        Every turn expands the best few members of each beam not yet expanded; a query ends when all are.
        """
        (_, row, links), vectors, n = self.layers[layer], self.vectors, len(self.vectors)
        if self.turn > 1 << 30:
            self.seen[:], self.turn = 0, 1
        begun, ahead = self.turn, max(1, beam // 8)
        ids = np.full((len(queries), beam), -1)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        done = np.zeros((len(queries), beam), bool)
        live = np.arange(len(queries))
        at, column = np.nonzero(start >= 0)
        nodes = start[at, column]
        while True:
            place = at * n + nodes
            new = self.seen[place] < begun
            at, nodes, place = at[new], nodes[new], place[new]
            mark = np.arange(self.turn, self.turn + len(place), dtype=np.int32)
            self.seen[place] = mark
            once = self.seen[place] == mark  # found from two members in one turn
            self.turn += len(place)
            at, nodes = at[once], nodes[once]
            near = np.einsum("ij,ij->i", vectors[nodes], queries[at])
            better = near > sims[at, -1]
            at, nodes, near = at[better], nodes[better], near[better]
            if len(at):
                counts = np.bincount(at, minlength=len(queries))
                rows = np.flatnonzero(counts)
                counts = counts[rows]
                column = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
                to = np.repeat(np.arange(len(rows)), counts)
                more = np.full((len(rows), counts.max()), -1)
                more_sims = np.full(more.shape, -np.inf, np.float32)
                more[to, column], more_sims[to, column] = nodes, near
                all_sims = np.concatenate([sims[rows], more_sims], axis=1)
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                sims[rows] = np.take_along_axis(all_sims, order, 1)
                ids[rows] = np.take_along_axis(np.concatenate([ids[rows], more], axis=1), order, 1)
                done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(more.shape, bool)], axis=1), order, 1)
            left = ~done[live] & (ids[live] >= 0)
            going = left.any(axis=1)
            live, left = live[going], left[going]
            if not len(live):
                return ids, sims
            at, column = np.nonzero(left & (np.cumsum(left, axis=1) <= ahead))
            at = live[at]
            done[at, column] = True
            nodes = links[row[ids[at, column]]]
            at, nodes = np.repeat(at, nodes.shape[1]), nodes.ravel()
            at, nodes = at[nodes >= 0], nodes[nodes >= 0]

    def _choose(self, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions, for each row: each nearer to the row's node than to those before it.

        ``found`` is sorted by ``sims``, with -1 after the last; half of ``most`` are chosen at least.
        """
        held = found >= 0
        near = self.vectors[found]
        between = near @ near.transpose(0, 2, 1)
        taken, hidden = np.zeros(found.shape, bool), ~held
        room = np.full(len(found), most)
        for k in range(found.shape[1]):
            take = ~hidden[:, k] & (room > 0)
            taken[:, k] = take
            room -= take
            hidden |= take[:, None] & (between[:, k] >= sims)
        rest = held & ~taken
        rest &= np.cumsum(rest, axis=1) <= (most // 2 - taken.sum(axis=1))[:, None]
        taken |= rest
        out = np.full((len(found), most), -1, np.int32)
        at, column = np.nonzero(taken)
        out[at, (np.cumsum(taken, axis=1) - 1)[at, column]] = found[at, column]
        return out

    def _join(self, batch: np.ndarray, found: np.ndarray, sims: np.ndarray, layer: int) -> None:
        _, row, links = self.layers[layer]
        most = links.shape[1]
        found = np.where(np.isfinite(sims), found, -1)
        chosen = self._choose(found, sims, LINKS)
        links[row[batch], :LINKS] = chosen
        at, column = np.nonzero(chosen >= 0)
        order = np.argsort(chosen[at, column], kind="stable")
        others, counts = np.unique(chosen[at, column], return_counts=True)
        back = batch[at[order]]
        held = (links[row[others]] >= 0).sum(axis=1)
        to = np.repeat(np.arange(len(others)), counts)
        column = np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts) + held[to]
        fits = (held + counts <= most)[to]
        links[row[others[to[fits]]], column[fits]] = back[fits]
        full = np.flatnonzero(held + counts > most)
        full = full[np.argsort(held[full] + counts[full], kind="stable")]
        while len(full):
            wide = held[full] + counts[full]
            now = max(1, int(np.searchsorted(np.arange(1, len(full) + 1) * wide**2, PRODUCT, side="right")))
            some, full = full[:now], full[now:]
            place = np.full(len(others), -1)
            place[some] = np.arange(len(some))
            known = np.full((len(some), int(wide[:now].max())), -1)
            known[:, :most] = links[row[others[some]]]
            mine = place[to] >= 0
            known[place[to[mine]], column[mine]] = back[mine]
            near = np.einsum("ijk,ik->ij", self.vectors[known], self.vectors[others[some]])
            near[known < 0] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")
            links[row[others[some]]] = self._choose(np.take_along_axis(known, order, 1), np.take_along_axis(near, order, 1), most)

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Members found next to each query and their cosines, best first, as ``_walk`` gives them."""
        parts = []
        for first in range(0, len(queries), self.side):
            block = queries[first : first + self.side]
            near = np.full((len(block), 1), self.entry)
            for k in range(len(self.layers) - 1, 0, -1):
                near = self._walk(block, near, 1, k)[0]
            parts.append(self._walk(block, near, beam, 0))
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([sims for _, sims in parts])

    def within(self, q: np.ndarray, least: float) -> np.ndarray:
        """Members with a cosine of at least ``least`` to one vector."""
        return next(found for _, found in self.all_within(q[None], least))

    def all_within(self, queries: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the query, members with a cosine of at least ``least``) of every query.

        A beam with a member below ``least`` holds all links. Queries whose beam is full of links
        lie in a dense group: they are compared with the whole shard, by one matrix product a block,
        which costs less than wider beams. So are all queries if no beam passed the audit.
        """
        dense: list[int] = []
        for first in range(0, len(queries), self.side):
            block = range(first, min(first + self.side, len(queries)))
            if self.beam > WIDEST_BEAM:
                dense.extend(block)
                continue
            ids, sims = self.nearest(queries[block.start : block.stop], self.beam)
            sizes = (ids >= 0).sum(axis=1)
            links = (sims >= least).sum(axis=1)
            for k, found, size, n in zip(block, ids, sizes.tolist(), links.tolist()):
                if n < size or size == len(self.vectors):
                    yield k, found[:n]
                else:
                    dense.append(k)
        step = max(1, PRODUCT // len(self.vectors))
        for first in range(0, len(dense), step):
            block = dense[first : first + step]
            rows, members = np.nonzero(queries[block] @ self.vectors.T >= least)
            cuts = np.searchsorted(rows, np.arange(1, len(block)))
            yield from zip(block, np.split(members, cuts))

    def audit(self, least: float = LEAST_RECALL) -> None:
        """Double the beam until it finds enough of two kinds of known links of a sample.

        These are the members that queries were turned away from by the angle of a link, and all
        links of the sampled members themselves, known from comparing these with the whole shard.
        """
        rng = np.random.default_rng(len(self.vectors))
        pick = rng.choice(len(self.vectors), min(AUDITS, len(self.vectors)), replace=False)
        base = self.vectors[pick].astype(float)
        away = rng.standard_normal(base.shape)
        away -= (away * base).sum(axis=1, keepdims=True) * base
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        turned = (THRESHOLD * base + math.sqrt(1 - THRESHOLD**2) * away).astype(np.float32)
        own = self.vectors[pick]
        real = [np.flatnonzero(row >= THRESHOLD) for row in own @ self.vectors.T]
        known = [*pick[:, None], *real]
        wanted = np.array([len(targets) for targets in known])
        while self.beam <= WIDEST_BEAM:
            ids, sims = self.nearest(np.concatenate([turned, own]), self.beam)
            # links behind a full beam of links are found by comparing the shard
            last = np.take_along_axis(sims, (ids >= 0).sum(axis=1)[:, None] - 1, 1)[:, 0]
            full = last >= THRESHOLD - 1e-4
            hits = np.array([len(np.intersect1d(targets, found)) for targets, found in zip(known, ids)])
            hits = np.where(full, wanted, hits)
            if all(hits[k].sum() >= least * wanted[k].sum() for k in (slice(len(pick)), slice(len(pick), None))):
                return
            self.beam *= 2

    def dump(self, vectors: bool = True) -> bytes:
        """Without ``vectors``, ``load`` has to be given them."""
        arrays = {"head": np.array([self.entry, self.beam])} | ({"vectors": self.vectors} if vectors else {})
        for k, (nodes, _, links) in enumerate(self.layers):
            arrays |= {f"nodes{k}": nodes.astype(np.int32), f"links{k}": links}
        return _packed(arrays)

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray | None = None) -> Graph:
        arrays = np.load(io.BytesIO(data))
        layers = []
        while f"nodes{len(layers)}" in arrays:
            layers.append((arrays[f"nodes{len(layers)}"], arrays[f"links{len(layers)}"]))
        entry, beam = arrays["head"].tolist()
        return cls(arrays["vectors"] if vectors is None else vectors, layers, entry, beam)


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Doubles, one row per vector; all have the same length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _write(path: str, data: bytes) -> None:
    store, place = file_store(path)
    with store.open_output_stream(place) as out:
        out.write(data)


def _read(path: str) -> bytes:
    store, place = file_store(path)
    with store.open_input_file(place) as file:
        return file.read()


def _built(table: pa.Table, base: str) -> pa.Table:
    """Writes members and graph of a shard from its rows; one row (width, path, n).

    Names are new in every attempt: what a lost attempt leaves is never read.
    """
    ids = table["rep"].to_numpy()
    order = np.argsort(mix(ids.view(np.uint64)), kind="stable")
    table, ids = table.take(pa.array(order)), ids[order]
    x = _matrix(table["embedding"], len(ids))
    graph = Graph.build(_unit(x).astype(np.float32), ids)
    graph.audit()
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    store, root = file_store(base)
    store.create_dir(root, recursive=True)
    path = f"{base}/{uuid.uuid4().hex}"
    members = {"ids": ids, "weights": table["n"].to_numpy(), "vectors": short if np.array_equal(short, x) else x}
    _write(f"{path}.members", _packed(members))
    _write(f"{path}.graph", graph.dump(vectors=False))
    return pa.table(
        {"width": table["width"][:1].combine_chunks(), "path": pa.array([path]), "n": pa.array([len(ids)], pa.int64())}
    )


def _queried(queries: str, first: int, size: int, shard: str) -> pa.RecordBatch:
    """Rows (a, links, b) of ``size`` members of one shard, from ``first`` on, against another (paths of both).

    A query's links into the shard by number, and enough links to unite what they join.
    """
    held = np.load(io.BytesIO(_read(f"{shard}.members")))
    ids, weights, unit = held["ids"], held["weights"], _unit(held["vectors"])
    graph = Graph.load(_read(f"{shard}.graph"), unit.astype(np.float32))
    asked = np.load(io.BytesIO(_read(f"{queries}.members")))
    own, exact = asked["ids"][first : first + size], _unit(asked["vectors"][first : first + size])
    a_out, n_out, b_out = [], [], []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at, found in graph.all_within(exact.astype(np.float32), THRESHOLD - 1e-4):
        k, q = int(own[at]), exact[at]
        found = found[(unit[found] @ q >= THRESHOLD) & (ids[found] != k)]
        if not len(found):
            continue
        a_out.append(k), n_out.append(int(weights[found].sum())), b_out.append(None)
        for other in ids[found].tolist():
            x, y = find(k), find(other)
            if x != y:
                root[max(x, y)] = min(x, y)
                a_out.append(k), n_out.append(0), b_out.append(other)
    columns = {"a": pa.array(a_out, pa.int64()), "links": pa.array(n_out, pa.int64()), "b": pa.array(b_out, pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pair in batch.to_pylist():
            yield _queried(**pair)


def usable(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs with a cosine of THRESHOLD or more, of equal length;
    equal vectors are one class and linked with each other. Null and zero
    vectors, and those with null or non-finite components, have no links.
    Rows with a null vec_id are linked with nothing and kept (component_id
    null). Rows that repeat a vec_id are vectors of their own that share a
    component if their vectors are equal. Columns other than vec_id and
    embedding are not read. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double")))
    floats = isinstance(getattr(embeddings.schema["embedding"].dataType, "elementType", None), T.FloatType)
    rows = stage(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("embedding"))
        .withColumn("fine", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        .withColumn("print1", F.xxhash64("embedding"))
        .withColumn("print2", F.xxhash64(F.lit(1), F.reverse("embedding")))
        .withColumn("width", F.when(F.col("fine"), F.size("embedding")))
        .withColumn("embedding", F.col("embedding").cast("array<float>" if floats else "array<double>")),
        "vectors",
    )
    prints = ["width", "print1", "print2"]
    classes = stage(
        rows.where("fine").groupBy(*prints).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors"
    )
    reps = stage(
        classes.join(rows.select(F.col("vec_id").alias("rep"), *prints, "embedding"), ["rep", *prints])
        .dropDuplicates(["rep", *prints]),
        "vectors",
    )
    total = reps.agg(F.coalesce(F.sum("width"), F.lit(0)).alias("size")).first()["size"]
    shards = max(LEAST_SHARDS, math.ceil(total / SHARD_SIZE))
    dealt = reps.withColumn("shard", F.pmod(F.xxhash64(F.lit(2), *prints), F.lit(shards)).cast("int"))
    base = folder(spark, "graphs")
    graphs = stage(
        dealt.groupBy("width", "shard").applyInArrow(lambda table: _built(table, base), "width int, path string, n long"), "graphs"
    )
    size = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SIZE) / F.col("width")))
    blocks = graphs.select("width", F.col("path").alias("queries"), F.explode(F.sequence(F.lit(0), F.col("n") - 1, size)).alias("first"), size.alias("size"))
    pairs = stage(blocks.join(graphs.select("width", F.col("path").alias("shard")), "width").drop("width"), "pairs")
    tasks = max(1, min(pairs.count(), MOST_TASKS))
    found = stage(pairs.repartition(tasks).mapInArrow(_compared, "a long, links long, b long"), "links")
    group = components(found.where("b is not null").select("a", "b"), "links")
    counted = found.groupBy("a").agg(F.sum("links").alias("links"))
    homes = stage(
        classes.join(group, classes["rep"] == group["node"], "left").join(counted, classes["rep"] == counted["a"], "left")
        .select(
            *prints, F.coalesce("component", "rep").alias("component"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "vectors",
    )
    out = rows.select("vec_id", *prints).join(homes, prints, "left")
    own = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )


def op3_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The definition: all pairs by cosine, components by reachability.
ORACLE_SQL = f"""
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ways AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reached AS (
  SELECT a AS vec_id, a AS node FROM ways UNION SELECT r.vec_id, w.b FROM reached r JOIN ways w ON w.a = r.node),
groups AS (SELECT vec_id, min(node) AS component_id FROM reached GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN groups USING (vec_id)
"""
