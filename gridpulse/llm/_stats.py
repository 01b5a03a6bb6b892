"""Counts of every text, computed from its bytes in one pass inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridpulse.llm._text import SPACE, mix, slices, span_hashes, spans, windows

#: Classes of bytes that are counted; fixed values.
CLASSES = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_lower": bytes(range(97, 123)),
    "n_digits": b"0123456789",
    "n_bars": b"|",
    "n_marks": b"!?",
    "n_stops": b".,;:",
    "n_quotes": b"\"'()[]{}",
}
COUNTS = [
    "n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_short_words",
    "n_long_words", "n_full_lines", *CLASSES,
]


def _by_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[bounds])


def _first_in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether an element is the first of its hash in its row (one of them, as equal elements go)."""
    key = hashes ^ mix(row.astype(np.uint64) + np.uint64(1))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return first


def counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of every row of a slice."""
    rows = len(bounds) - 1
    starts, ends, n = spans(data, bounds)
    row = np.repeat(np.arange(rows), n)
    word_bounds = np.append(0, np.cumsum(n))
    out = {"n_words": n, "word_chars": _by_row(~SPACE[data] & ((data & 0xC0) != 0x80), bounds)}

    breaks = np.flatnonzero(data == 0x0A)
    head = np.unique(np.concatenate([bounds[:-1][bounds[:-1] < bounds[1:]], breaks + 1]))
    head = head[head < len(data)]
    tail = np.append(head[1:], len(data))
    tail = tail - ((tail > 0) & (data[np.maximum(tail, 1) - 1] == 0x0A)) if len(data) else tail
    worded = np.searchsorted(starts, tail) > np.searchsorted(starts, head)
    head, tail = head[worded], tail[worded]
    line_row = np.searchsorted(bounds, head, "right") - 1
    first = _first_in_row(span_hashes(data, head, tail, False), line_row)
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    out["n_dup_lines"] = np.bincount(line_row, ~first, minlength=rows).astype(np.int64)
    last_word = ends[np.searchsorted(starts, tail) - 1] - 1
    out["n_full_lines"] = np.bincount(line_row, np.isin(data[last_word], list(b".!?:;\"'")), minlength=rows).astype(np.int64)

    hashes = span_hashes(data, starts, ends, False)
    out["n_distinct_words"] = _by_row(_first_in_row(hashes, row), word_bounds)
    width = ends - starts
    out["n_short_words"] = _by_row(width <= 3, word_bounds)
    out["n_long_words"] = _by_row(width >= 16, word_bounds)
    covered = np.zeros(len(hashes), bool)
    triples = windows(hashes, 3)
    if len(triples):
        at = np.flatnonzero(row[2:] == row[:-2])
        key = triples[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    out["n_repeat_words"] = _by_row(covered, word_bounds)

    of = np.repeat(np.arange(rows, dtype=np.int64) * 256, np.diff(bounds))
    table = np.bincount(of + data, minlength=rows * 256).reshape(rows, 256)
    for name, members in CLASSES.items():
        out[name] = table[:, list(members)].sum(axis=1)
    return out


def _add(batches: Iterator[pa.RecordBatch], text: str, name: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [counts(data, bounds) for _, _, data, bounds in slices(batch.column(text))]
        fields = [
            pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64))
            for c in COUNTS
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.StructArray.from_arrays(fields, COUNTS)], [*keep, name]
        )


def with_counts(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and a struct ``name`` of the COUNTS of column text."""
    types = dict(df.dtypes)
    schema = [f"`{c}` {types[c]}" for c in keep] + [f"`{name}` struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"]
    needed = list(dict.fromkeys([*keep, "text"]))
    return df.select(*needed).mapInArrow(lambda it: _add(it, "text", name, keep), ", ".join(schema))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish in taken:
        wish += "_"
    return wish
