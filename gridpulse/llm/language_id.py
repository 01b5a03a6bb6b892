"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram binds the
three vectors, the first two permuted by two and one places; a document
bundles its trigrams, a language the unit vectors of its documents. The
language whose prototype has the greatest cosine with the document wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm._letters import codes, tables
from gridpulse.llm._text import mix, slices

WIDTH = 1024
#: Documents that a language's prototype is learned from, in expectation.
MOST_PER_LANGUAGE = 3000
UNKNOWN = "und"
_CELLS = 1 << 24
_SLICE = 1 << 21


def letter_vectors(points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Vectors of +1 and -1, drawn from the code point alone; 0 is the gap between words."""
    words = width // 64
    bits = mix(mix(points.astype(np.uint64)[:, None] + np.uint64(1)) + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def bundles(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the trigram vectors of every row, number of its trigrams)."""
    rows = len(bounds) - 1
    points, at = codes(data, bounds)
    letter, lower = tables()
    full = letter[points]
    keep = full.copy()
    keep[1:] |= full[:-1]
    kept = np.where(full, lower[points], 0)[keep]
    row = np.repeat(np.arange(rows), np.diff(at))[keep]
    out = np.zeros((rows, width), np.float32)
    if not len(kept):
        return out, np.zeros(rows, np.int64)
    alphabet = np.unique(kept)
    seat = np.searchsorted(alphabet, kept)
    gap = seat[-1]  # the last kept point is a gap; rows end with one
    before = np.append(gap, seat[:-1])
    first = np.append([gap, gap], seat[:-2])[: len(seat)]
    held = before != gap
    n = len(alphabet)
    gram = (first * n + before) * n + seat
    gram, row = gram[held], row[held]
    if n**3 <= 1 << 23:
        there = np.flatnonzero(np.bincount(gram, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[there] = np.arange(len(there))
        gram = place[gram]
    else:
        there, gram = np.unique(gram, return_inverse=True)
    base = letter_vectors(alphabet, width)
    a, b, c = there // (n * n), there // n % n, there % n
    step = max(1, _CELLS // max(len(there), 1))
    part = max(1, _CELLS // width)
    for low in range(0, rows, step):
        high = min(low + step, rows)
        i, j = np.searchsorted(row, [low, high])
        count = np.bincount((row[i:j] - low) * len(there) + gram[i:j], minlength=(high - low) * len(there))
        count = count.reshape(high - low, len(there)).astype(np.float32)
        for k in range(0, len(there), part):
            s = slice(k, k + part)
            bound = np.roll(base[a[s]], 2, axis=1) * np.roll(base[b[s]], 1, axis=1) * base[c[s]]
            out[low:high] += count[:, s] @ bound
    return out, np.bincount(row, minlength=rows)


@dataclass(frozen=True)
class Profiles:
    """Languages in order and their unit prototypes, one row each."""

    languages: tuple[str, ...]
    vectors: np.ndarray


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, end, data, bounds in slices(batch.column("text"), _SLICE):
            made, n = bundles(data, bounds)
            made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
            here = langs[first:end]
            for lang in sorted(set(here[n > 0])):
                total = made[(here == lang) & (n > 0)].sum(axis=0, dtype=np.float64)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "total": [total.tolist()]}, schema=pa.schema([("lang", pa.string()), ("total", pa.list_(pa.float64()))]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(documents: DataFrame, most: int = MOST_PER_LANGUAGE) -> Profiles:
    """Prototypes from the rows with a language that are not held out.

    Languages are counted over all rows; of a language with more than
    ``most`` documents, those with the smallest hash of doc_id are taken,
    so many in expectation. What reaches the driver is one sum per slice of
    that bounded sample.
    """
    known = documents.where("lang is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counted = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    share = F.create_map(*[x for lang, n in counted for x in (F.lit(lang), F.lit(min(1.0, most / n)))]) if counted else None
    if share is None:
        return Profiles((), np.zeros((0, WIDTH)))
    rank = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(rank < share[F.col("lang")])
    parts = sample.mapInArrow(_sums, "lang string, total array<double>").collect()
    sums = {lang: np.zeros(WIDTH) for lang, _ in counted}
    for r in parts:
        sums[r["lang"]] += np.array(r["total"])
    named = [lang for lang in sums if np.any(sums[lang])]
    if not named:
        return Profiles((), np.zeros((0, WIDTH)))
    made = np.array([sums[lang] / np.linalg.norm(sums[lang]) for lang in named])
    return Profiles(tuple(named), made)


def _identify(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    names = np.array([*profiles.languages, UNKNOWN], object)
    against = profiles.vectors.T.astype(np.float32)
    for batch in batches:
        for first, end, data, bounds in slices(batch.column("text"), _SLICE):
            made, n = bundles(data, bounds)
            score = np.zeros(len(n))
            best = np.full(len(n), len(names) - 1)
            if len(profiles.languages):
                cosine = made @ against / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
                best = np.where(n > 0, cosine.argmax(axis=1), best)
                score = np.where(n > 0, np.clip(cosine.max(axis=1), 0, 1), 0.0).astype(float)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id")[first:end],
                    "lang_pred": pa.array(names[best].tolist(), pa.string()),
                    "score": pa.array(score, pa.float64()),
                }
            )


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine, 0 to 1).

    Texts that are null or have no letter are ``und`` with score 0, as is
    every text where nothing was learned. Of languages with equal cosine
    the first by name wins. Repeated rows are judged each. Columns other
    than doc_id and text are not read. An empty table gives no rows.
    """
    found = documents.select("doc_id", "text").mapInArrow(
        lambda it: _identify(it, profiles), f"doc_id {dict(documents.dtypes)['doc_id']}, lang_pred string, score double"
    )
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, learn(documents))
