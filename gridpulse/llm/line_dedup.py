"""Lines that many documents share, found with two Bloom filters.

A line's key is the line stripped of ASCII white space with A-Z folded. The
first filter holds the keys seen in any document, the second those seen
again: bits that two documents have set. Filters are cut into segments, so
that tasks send only the bits they set, and segments merge apart from each
other. A key found in several documents has all its bits in the second
filter, so only keys it holds are shuffled to be counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm._stage import stage
from gridpulse.llm._stats import free_name
from gridpulse.llm._text import mix

#: A key is common when this many documents hold it.
LEAST_DOCUMENTS = 10
#: Keys below this many code points are never common.
LEAST_POINTS = 1
#: Bits of a filter per line, positions of a key (all in one segment), bits of a segment.
LINE_BITS, HASHES, SEGMENT_BITS = 8, 3, 1 << 20
#: Bits of a filter at most (64 MB to broadcast); beyond, the second filter holds more keys than
#: needed, so that more are counted exactly. Results are the same.
MOST_BITS = 1 << 29
#: Common keys to broadcast (3.2 MB); beyond, they are joined to the documents that hold them.
MOST_KEYS = 200_000
#: Bit positions a task gathers before it sends them.
GATHERED = 1 << 22


def line_keys(text: bytes) -> list[bytes]:
    """Keys of all lines of a UTF-8 text; bytes strip and fold ASCII only."""
    return [line.strip().lower() for line in text.split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least < 2 or len(key.decode("utf-8", "replace")) >= least)


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()


def _document_keys(column: pa.Array, least: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct keys of each document one after another, and how many each has."""
    keys: list[bytes] = []
    counts = []
    for text in _texts(column):
        own = {k for k in line_keys(text) if _long_enough(k, least)}
        keys.extend(own)
        counts.append(len(own))
    return keys, np.array(counts, np.int64)


def _positions(keys: list[bytes], segments: int) -> np.ndarray:
    """(keys, HASHES) bit positions in a filter of ``segments`` segments."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    base = (h % np.uint64(segments)).astype(np.int64) * SEGMENT_BITS
    bits = mix(h)
    width = np.uint64(SEGMENT_BITS.bit_length() - 1)
    mask = np.uint64(SEGMENT_BITS - 1)
    return np.stack([base + ((bits >> (width * np.uint64(k))) & mask).astype(np.int64) for k in range(HASHES)], axis=1)


def _packed(places: np.ndarray) -> bytes:
    """Sorted positions of a segment as 32-bit numbers, or as a bitmap where that is shorter."""
    if len(places) * 32 < SEGMENT_BITS:
        return places.astype("<u4").tobytes()
    flags = np.zeros(SEGMENT_BITS, bool)
    flags[places] = True
    return np.packbits(flags).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) * 8 < SEGMENT_BITS:
        return np.frombuffer(data, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def _pieces(seen: np.ndarray) -> pa.RecordBatch:
    """Rows (segment, once, twice) of the positions that documents have set."""
    places, times = np.unique(seen, return_counts=True)
    segment = places // SEGMENT_BITS
    found, first = np.unique(segment, return_index=True)
    inside = places % SEGMENT_BITS
    once, twice = [], []
    for a, b in zip(first, np.append(first[1:], len(places))):
        once.append(_packed(inside[a:b]))
        twice.append(_packed(inside[a:b][times[a:b] > 1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(found.astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
        ["segment", "once", "twice"],
    )


def _set_bits(batches: Iterator[pa.RecordBatch], segments: int, least: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in batches:
        keys, _ = _document_keys(batch.column(0), least)
        held.append(_positions(keys, segments).ravel())
        if sum(map(len, held)) >= GATHERED:
            yield _pieces(np.concatenate(held))
            held = []
    if sum(map(len, held)):
        yield _pieces(np.concatenate(held))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (segment, filter) per segment of rows sorted by segment; a bit set by two pieces is in the second filter."""
    now, once, twice = None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
            ["segment", "filter"],
        )

    for batch in batches:
        for segment, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if segment != now:
                if now is not None:
                    yield row()
                now, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            places = _unpacked(a)
            twice[places[once[places]]] = True
            once[places] = True
            twice[_unpacked(b)] = True
    if now is not None:
        yield row()


def _suspected(keys: list[bytes], filters: np.ndarray, segments: int) -> np.ndarray:
    """Whether the second filter holds a key."""
    at = _positions(keys, segments)
    return ((filters[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def repeated_bits(documents: DataFrame, least: int = LEAST_POINTS) -> tuple[np.ndarray, int]:
    """The second filter over all documents (column text) and its number of segments."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n")))
    lines = documents.agg(F.coalesce(F.sum(F.coalesce(breaks, F.lit(0)) + 1), F.lit(0)).alias("n")).first()["n"]
    bits = min(max(lines * LINE_BITS, SEGMENT_BITS), MOST_BITS)
    segments = 1 << math.ceil(math.log2(bits / SEGMENT_BITS))
    pieces = documents.select("text").mapInArrow(
        lambda it: _set_bits(it, segments, least), "segment int, once binary, twice binary"
    )
    merged = pieces.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, filter binary")
    filters = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
    for row in merged.collect():  # both bounded by MOST_BITS
        at = row["segment"] * SEGMENT_BITS // 8
        filters[at : at + SEGMENT_BITS // 8] = np.frombuffer(row["filter"], np.uint8)
    return filters, segments


def _suspects(batches: Iterator[pa.RecordBatch], filters, segments: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, owner) of the suspected keys of each document, each once; owner is the second column."""
    for batch in batches:
        keys, counts = _document_keys(batch.column(0), least)
        at = np.flatnonzero(_suspected(keys, filters.value, segments))
        of = np.repeat(np.arange(len(counts)), counts)[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_digest(keys[k]) for k in at.tolist()], pa.binary()), batch.column(1).take(pa.array(of))],
            ["key", "owner"],
        )


def common_lines(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_points: int = LEAST_POINTS
) -> tuple[DataFrame, DataFrame]:
    """(common, suspects): keys of at least ``least_documents`` documents, as 16-byte digests with the
    smallest doc_id that holds them (key, first), and a frame (key, owner) of suspected keys, owner the document's row key.

    Counts combine before they are shuffled. Every row is a document, also if ids or texts repeat.
    """
    spark = documents.sparkSession
    filters, segments = repeated_bits(documents, least_points)
    shared = spark.sparkContext.broadcast(filters)
    found = documents.select("text", F.col("doc_id").cast("long").alias("owner")).mapInArrow(
        lambda it: _suspects(it, shared, segments, least_points), "key binary, owner long"
    )
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.min("owner").alias("first"))
    common = stage(counted.where(F.col("n") >= least_documents).select("key", "first"), "lines")
    suspects = documents.select("text", _row_key("doc_id", "text").alias("owner")).mapInArrow(
        lambda it: _suspects(it, shared, segments, least_points), "key binary, owner binary"
    )
    return common, suspects


def _row_key(doc_id: str, text: str) -> Column:
    """Digest of id and text: equal rows are alike in all that matters here."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def _drop(
    batches: Iterator[pa.RecordBatch], columns: list[str], name: str, least: int, first: bool, found
) -> Iterator[pa.RecordBatch]:
    """Columns, and a struct of counts and the text that stays.

    After the columns come text and id. ``found`` gives for every row of a
    batch the common keys it may hold, with the document in which the first
    line of a key stays.
    """
    for batch in batches:
        lines, dropped, kept = [], [], []
        texts, ids = _texts(batch.column(len(columns))), batch.column(len(columns) + 1).to_pylist()
        for text, own, common in zip(texts, ids, found(batch)):
            parts = text.split(b"\n")
            lines.append(len(parts))
            left = []
            stay: set[bytes] = set()
            for part in parts:
                key = part.strip().lower()
                digest = _digest(key) if common and _long_enough(key, least) else None
                if digest in common:
                    if not first or common[digest] != own or digest in stay:
                        continue
                    stay.add(digest)
                left.append(part)
            dropped.append(len(parts) - len(left))
            kept.append(b"\n".join(left).decode())
        fields = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
        made = pa.StructArray.from_arrays(fields, ["n_lines", "n_dropped", "text"])
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], made], [*columns, name])


def with_kept_lines(
    documents: DataFrame,
    name: str,
    columns: list[str],
    least_documents: int = LEAST_DOCUMENTS,
    least_points: int = LEAST_POINTS,
    keep_first: bool = False,
) -> DataFrame:
    """``columns`` and a struct ``name`` (n_lines, n_dropped, text) of what common lines leave.

    A line goes when its key is common; with ``keep_first`` the first such
    line of the smallest doc_id stays (in each row of that id; nowhere if no
    document of the key has an id). Lines are split at \\n only, other lines
    stay as they are, joined by \\n. A null or empty text is one empty line,
    which is never common. Every row counts as a document, also a repeated
    one. Texts of any length are read whole. An empty table gives no rows.
    """
    common, suspects = common_lines(documents, least_documents, least_points)
    types = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), f"`{name}` struct<n_lines:bigint,n_dropped:bigint,text:string>"])
    text, own_id, owner, held = (free_name(documents, x) for x in ("corpus_text", "corpus_id", "corpus_owner", "corpus_common"))
    source = documents.select(*columns, F.col("text").alias(text), F.col("doc_id").cast("long").alias(own_id))

    def dropped(df: DataFrame, found) -> DataFrame:
        return df.mapInArrow(lambda it: _drop(it, columns, name, least_points, keep_first, found), schema)

    if common.count() <= MOST_KEYS:
        shared = documents.sparkSession.sparkContext.broadcast({bytes(r["key"]): r["first"] for r in common.collect()})
        return dropped(source, lambda batch: [shared.value] * batch.num_rows)
    owners = stage(
        suspects.join(common, "key").groupBy(F.col("owner").alias(owner)).agg(F.collect_set(F.struct("key", "first")).alias(held)),
        "lines",
    )
    keyed = source.withColumn(owner, _row_key(own_id, text)).join(owners, owner, "left").select(*source.columns, held)
    return dropped(
        keyed, lambda batch: [{x["key"]: x["first"] for x in row or ()} for row in batch.column(batch.num_columns - 1).to_pylist()]
    )


def kept_documents(documents: DataFrame, **how) -> DataFrame:
    """The rows of ``documents`` with the text that common lines leave; all columns as they were."""
    name = free_name(documents, "corpus_lines")
    rest = [c for c in documents.columns if c != "text"]
    out = with_kept_lines(documents, name, rest, **how)
    return out.select(*(F.col(name)["text"].alias(c) if c == "text" else F.col(c) for c in documents.columns))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = with_kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lines", ["doc_id"])
    c = F.col("lines")
    return lines.select("doc_id", c["n_lines"].alias("n_lines"), c["n_dropped"].alias("n_dropped"), F.sha2(c["text"], 256).alias("kept_sha256"))


#: The definition: lines by position, keys counted over rows.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT k, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= {LEAST_POINTS} GROUP BY key HAVING count(DISTINCT k) >= {LEAST_DOCUMENTS}),
judged AS (SELECT k, i, line, key IN (SELECT key FROM common) AS gone FROM keyed),
kept AS (
  SELECT k, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM judged GROUP BY k)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM docs JOIN kept USING (k)
"""
