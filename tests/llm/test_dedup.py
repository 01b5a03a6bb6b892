"""Near-duplicates of documents and embeddings against all-pairs versions."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpulse.llm import _stage, embedding_dedup, minhash_dedup
from gridpulse.llm._stage import components
from gridpulse.llm._text import slices, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_documents(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = collections.Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    links = [p for p, n in both.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    found = roots(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def check_documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(df).collect()}
    want = brute_documents(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_edited_copies_and_shared_passages(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = []
    for d in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for copy in range(6):
            text = list(base)
            for k in rng.integers(0, 200, rng.integers(0, 14)):
                text[k] = f"e{rng.integers(0, 9999)}"
            joined = " ".join(text)
            rows.append((len(rows), joined + ("\n" + passage if d % 2 else "") if copy % 3 else joined.upper()))
    check_documents(spark, rows)


@pytest.mark.parametrize("most", [2, 100])
def test_buckets_beyond_the_bound_are_split(spark, monkeypatch, most):
    monkeypatch.setattr(minhash_dedup, "BUCKET", 8)
    monkeypatch.setattr(minhash_dedup, "MOST_BLOCKS", most)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(60):
        text = list(base)
        for k in rng.choice(150, 6, replace=False):
            text[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((d, " ".join(text)))
    check_documents(spark, rows)


@pytest.mark.parametrize("joined", [(), range(12)])
def test_large_buckets_compare_pairs_of_a_single_band(spark, monkeypatch, joined):
    monkeypatch.setattr(minhash_dedup, "BUCKET", 3)
    monkeypatch.setattr(minhash_dedup, "MOST_BLOCKS", 2)
    texts = {d: " ".join(f"w{d // 2}x{k}" for k in range(40)) + f" end{d}" for d in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [  # all share band 9 only; the documents in ``joined`` are one component already
        (d, 36, bytes(minhash_dedup.SLOTS), [7 if k == 9 else 1000 * (d + 1) + k for k in range(minhash_dedup.BANDS)], 0 if d in joined else d)
        for d in texts
    ]
    placed = spark.createDataFrame(rows, "rep long, n_shingles long, slots binary, bands array<long>, component long")
    got = {tuple(sorted(r)) for r in minhash_dedup._more_links(docs, placed, 75).collect()}
    assert got == {(d, d + 1) for d in range(0, 20, 2) if d not in joined}


def test_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_documents(spark, rows)


def test_repeated_ids_with_different_texts(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(30):
        text = list(base)
        for k in rng.choice(120, 4, replace=False):
            text[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((d, " ".join(text)))
    rows += [(3, "quite another text under the same id " * 3), (50, "quite another text under the same id " * 3)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(rows) and component[50] == component[3] == brute_documents(rows[:30])[3][1]


def test_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [
        (1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a b", 0), (5, "A  B\n", 0), (6, long, 0), (7, long + " end", 0),
        (8, "same text in two rows here", 0), (8, "same text in two rows here", 0), (None, "a b", 0), (9, "a b c", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    got = collections.defaultdict(list)
    for r in minhash_dedup.near_duplicates(df).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == got[2][:0] + [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)] and got[9] == [(1, 9, True)]
    assert got[6] == [(119_996, 6, True)] and got[7] == [(119_997, 6, False)]
    assert got[8] == [(2, 8, True)] * 2 and got[None] == [(1, None, True)]
    kept = minhash_dedup.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]
    assert minhash_dedup.near_duplicates(df.limit(0)).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=300, unique=True), st.data())
def test_signature_equals_the_plain_algorithm(items, data):
    slots = data.draw(st.sampled_from([4, 16, 32]))
    a = np.array(items, np.uint64)
    cut = data.draw(st.integers(0, len(a)))
    got = minhash_dedup.signatures(a, np.array([cut, len(a) - cut]), slots)
    for part, row in ((a[:cut], got[0]), (a[cut:], got[1])):
        want = np.full(slots, 0xFFFFFFFF, np.uint64)
        for x in part:  # every rank, no early stop
            order = list(range(slots))
            for j in range(slots):
                bits = int(minhash_dedup.mix(np.array([int(x) + 0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1)], np.uint64))[0])
                k = j + ((bits >> 32) * (slots - j) >> 32)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], (j << 24) + (bits & 0xFFFFFF))
        assert (row == want).all()


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.75):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**60, 400, dtype=np.uint64)
            n = int(200 * 2 * share / (1 + share))
            a, b = pool[:200], np.concatenate([pool[:n], pool[200 : 400 - n]])
            sig = minhash_dedup.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            true = n / (400 - n)
            errors.append((sig[0] == sig[1]).mean() - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < math.sqrt(share * (1 - share) / minhash_dedup.SLOTS) * 1.15


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té#"), max_size=6))
def test_words_of_bytes(texts):
    import pyarrow as pa

    for _, _, data, bounds in slices(pa.array(texts, pa.string())):
        hashes, counts = words(data, bounds)
        split = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
        assert counts.tolist() == [len(x) for x in split]
        flat = [w for x in split for w in x]
        assert len(set(hashes.tolist())) == len(set(flat))
        assert len({(w, h) for w, h in zip(flat, hashes.tolist())}) == len(set(flat))


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 50)]
    links += [(300 + i, 300 + (i + 1) % 20) for i in range(20)] + [(7, 7), (None, 3), (50, 40), (40, 50)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = roots({x for p in real for x in p}, real)
    assert {r["node"]: r["component"] for r in components(df).collect()} == want
    assert components(df.limit(0)).collect() == []


def counted(monkeypatch, module):
    """The tables that ``module`` stages from now on."""
    written = []

    def stage(df, name):
        written.append(name)
        return _stage.stage(df, name)

    monkeypatch.setattr(module, "stage", stage)
    return written


def test_components_of_stars_take_no_further_step(spark, monkeypatch):
    write, written = _stage.stage, []
    monkeypatch.setattr(_stage, "stage", lambda df, name: written.append(name) or write(df, name))
    links = [(d, d + k) for d in range(0, 100, 10) for k in range(1, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {d + k: d for d in range(0, 100, 10) for k in range(6)}
    assert len(written) == 2  # the links and their minima; a step more writes four tables


def test_later_links_unite_components_not_documents(spark, monkeypatch):
    seen = []

    def watched(edges, *name):
        seen.append(sorted(tuple(sorted(r)) for r in edges.collect()))
        return components(edges, *name)

    monkeypatch.setattr(minhash_dedup, "components", watched)
    written = counted(monkeypatch, minhash_dedup)
    more = [(3, 12, 1, 10), (14, 22, 10, 20)]  # documents 3 and 12 of the components 1 and 10, and so on
    monkeypatch.setattr(
        minhash_dedup, "_more_links",
        lambda documents, placed, least, *ends: spark.createDataFrame(
            more, "a long, b long, component_a long, component_b long").select(*(ends or ("a", "b"))),
    )
    texts = {d: " ".join(f"w{d // 10}x{k}" for k in range(60)) + f" end{d}" for d in (1, 2, 3, 10, 12, 14, 20, 22, 30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {d: 30 if d == 30 else 1 for d in texts}
    assert seen[1] == [(1, 10), (10, 20)]
    assert len(written) == 8


def brute_vectors(rows):
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if usable(v)}
    links = [
        (a, b) for a in good for b in good
        if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= embedding_dedup.THRESHOLD
    ]
    n = collections.Counter(x for p in links for x in p)
    found = roots([i for i, _ in rows], links)
    return {i: (n[i], found[i], i == found[i]) for i, _ in rows}


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_SIZE", 3000)


def test_vectors_against_brute_force(spark, small_shards):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (centre + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.33])).tolist()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [2 * x for x in rows[5][1]])]
    rows += [(1003, None), (1004, [0.0] * 24), (1005, [float("nan")] * 24), (1006, [None] * 24), (1007, []), (1008, [1.0, 0.0]), (1009, [1.0, 0.1]), (1010, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rep string")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_one_dense_group_and_null_ids(spark, small_shards):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.02).tolist()) for i in range(400)] + [(None, centre.tolist())]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == {(399, 0)}
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]


def test_graphs_lie_in_files_and_rows_carry_their_paths(spark, monkeypatch):
    """Work for a pair of block and shard is a short row, however many blocks there are."""
    staged = []
    keep = embedding_dedup.stage
    monkeypatch.setattr(embedding_dedup, "stage", lambda df, name: staged.append((name, keep(df, name))) or staged[-1][1])
    monkeypatch.setattr(embedding_dedup, "SHARD_SIZE", 800)
    monkeypatch.setattr(embedding_dedup, "BLOCK_SIZE", 300)
    rng = np.random.default_rng(12)
    rows = [(i, (np.eye(8)[i % 8] + rng.standard_normal(8) * 0.1).astype(np.float32).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert all(kind != "binary" for _, frame in staged for _, kind in frame.dtypes)
    found = dict(staged)
    sizes = [r["n"] for r in found["graphs"].collect()]
    assert sum(sizes) == 500 and len(sizes) == 5
    assert found["pairs"].count() == 5 * sum(-(-n // (300 // 8)) for n in sizes)


def test_graph_recall_and_round_trip():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = embedding_dedup.Graph.build(x, np.arange(1500))
    graph.audit()
    back = embedding_dedup.Graph.load(graph.dump())
    near = rng.standard_normal((200, 48)) * 0.03 + x[:200]
    near = (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)
    hit = [k in back.within(q, 0.95).tolist() for k, q in enumerate(near)]
    assert np.mean(hit) >= 0.98 and back.beam == graph.beam


def test_dense_queries_compare_the_shard_and_real_links_are_found():
    """Groups of 1 to 300: all links come back, block by block, and the audit's beam finds them."""
    rng = np.random.default_rng(9)
    sizes = [300, 80, 25, 24, 23, 5, 2, *[1] * 200]
    x = np.concatenate([rng.standard_normal(32) + 0.08 * rng.standard_normal((n, 32)) for n in sizes])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = embedding_dedup.Graph.build(x, np.arange(len(x)))
    graph.audit()
    assert graph.beam <= embedding_dedup.WIDEST_BEAM
    got = {k: set(found.tolist()) for k, found in graph.all_within(x, 0.95)}
    want = [set(np.flatnonzero(row >= 0.95).tolist()) for row in x @ x.T]
    assert sorted(got) == list(range(len(x))) and all(got[k] <= want[k] for k in got)
    assert sum(map(len, got.values())) >= 0.999 * sum(map(len, want))
    assert all(got[k] == want[k] for k in range(300))


def test_queries_without_a_passing_beam_compare_the_shard(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PRODUCT", 50)
    x = np.eye(8, dtype=np.float32)[np.arange(40) % 8]
    graph = embedding_dedup.Graph.build(x, np.arange(40))
    graph.beam = 2 * embedding_dedup.WIDEST_BEAM
    got = {k: found.tolist() for k, found in graph.all_within(x, 0.95)}
    assert got == {k: [m for m in range(40) if m % 8 == k % 8] for k in range(40)}
