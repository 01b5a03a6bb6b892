"""Common lines against a plain version."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from gridpulse.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, points=1, keep_first=False):
    """Kept text, number of lines and of dropped lines of every (doc_id, text)."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    keyed = [[line.strip(SPACE).translate(FOLD) for line in lines] for _, lines in split]
    n, first = collections.Counter(), {}
    for (i, _), keys in zip(split, keyed):
        for k in set(keys):
            n[k] += 1
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, lines), keys in zip(split, keyed):
        kept, stayed = [], set()
        for line, k in zip(lines, keys):
            common = len(k) >= points and n[k] >= least
            stays = keep_first and first.get(k) == i and i is not None and k not in stayed
            stayed |= {k} if common and stays else set()
            if not common or stays:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, owner string, n_lines int")
    made = line_dedup.with_kept_lines(docs.repartition(5), "lines", ["doc_id", "owner"], **how)
    got = [(r["doc_id"], *r["lines"]) for r in made.collect()]
    names = {"least_documents": "least", "least_points": "points"}
    want = plain(rows, **{names.get(k, k): v for k, v in how.items()})
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(120):
        lines = [f"own {i} {k}" for k in range(rng.integers(0, 6))]
        lines += [rng.choice(["Share it!", "  share IT!\t", "nine", "ÄHNLICH", "ähnlich", "", " \r", "x"]) for _ in range(4)]
        lines += ["only nine"] * 3 if i < 9 else ["just ten"] if i < 19 else []
        rng.shuffle(lines)
        out.append((i, "\n".join(lines)))
    return out + [(200, None), (201, ""), (202, "\n\n"), (None, "share it!\nmine"), (7, "x\nother"), (7, "x\nother"), (203, "w " * 200_000 + "\nX")]


@pytest.mark.parametrize("how", [{}, {"keep_first": True}, {"least_documents": 2}, {"least_points": 5}, {"least_points": 8, "keep_first": True}])
def test_lines_against_the_definition(spark, rows, how):
    check(spark, rows, **how)


def test_keys_beyond_the_broadcast_are_joined(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_KEYS", 0)
    check(spark, rows)
    check(spark, rows, keep_first=True)


def test_full_filters_change_nothing(spark, rows, monkeypatch):
    full = np.full(line_dedup.SEGMENT_BITS // 8, 255, np.uint8)
    monkeypatch.setattr(line_dedup, "repeated_bits", lambda documents, least: (full, 1))
    check(spark, rows)


@pytest.mark.parametrize("gathered", [1 << 22, 1000])
def test_few_unique_keys_are_suspected(monkeypatch, gathered):
    monkeypatch.setattr(line_dedup, "GATHERED", gathered)
    rng = np.random.default_rng(2)
    once = [b"line %d" % k for k in rng.integers(0, 1 << 60, 100_000)]
    twice = [b"shared %d" % k for k in range(5000)]
    parts = list(line_dedup._set_bits(batches([once[:50_000], twice, once[50_000:], twice]), 1, 1))
    rows = sorted((r for p in parts for r in p.to_pylist()), key=lambda r: r["segment"])
    merged = next(line_dedup._merged([pa.RecordBatch.from_pylist(rows)]))
    bits = np.frombuffer(merged.column(1)[0].as_py(), np.uint8)
    assert line_dedup._suspected(twice, bits, 1).all()
    assert line_dedup._suspected(once, bits, 1).mean() < 0.04


def batches(groups):
    for keys in groups:
        yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(keys).decode()])], ["text"])


def test_digests_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common\nown {i}") for i in range(10)] + [(10, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.op12_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (2, 1, hashlib.sha256(f"own {i}".encode()).hexdigest()) for i in range(10)} | {10: (1, 0, hashlib.sha256(b"").hexdigest())}
    empty = docs.limit(0)
    assert line_dedup.kept_documents(empty).collect() == [] and line_dedup.kept_documents(empty).columns == docs.columns


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, "a\nb", f"t{i}") for i in range(12)], "doc_id long, text string, corpus_text string")
    out = line_dedup.kept_documents(docs, keep_first=True)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: "a\nb" if i == 0 else "" for i in range(12)}
