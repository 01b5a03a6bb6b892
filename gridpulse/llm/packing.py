"""Lexical retrieval packing of tokenized documents into fixed windows.

Input partitions are cut into shards of consecutive documents. Each shard has
its own BM25 inverted index; a document that opens a window is the seed, and
its unused neighbours fill the window in order of score. A document that
does not fit is cut, and its rest opens the next window as the new seed.
No text is shuffled: tokenizing, indexing and packing happen where it is read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm._text import SPACE, slices, span_hashes, words

WINDOW = 2048
END_ID = 1
#: Rank file of the byte-level BPE; its ids are those of byte_bpe_50k.json.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Strings that byte_bpe_50k.json reads as one id; they hold no white space, so no cut falls into one.
SPECIAL = {"<|endoftext|>": 50256}
#: A shard ends with the document that brings it to either bound.
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 22
#: Terms of a seed that form its query: those of greatest BM25 weight.
QUERY_TERMS = 24
K1, B = 1.2, 0.75
#: A term in more than this share of a shard's documents is in no query.
COMMON = 0.25
SLICE = 1 << 21


@cache
def _tokenizer(name: str):
    """Encoder of that rank file and the byte length of every id, SPECIAL included."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(*ranks.values(), *SPECIAL.values()) + 1, np.int64)
    for token, rank in [*ranks.items(), *((t.encode(), k) for t, k in SPECIAL.items())]:
        sizes[rank] = len(token)
    encoder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return encoder, sizes


def chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts can be cut without changing their ids: before white space that follows none.

    The byte-level pattern never joins a visible character to white space
    after it. After characters that may be Unicode spaces nothing is cut.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        space = SPACE[data]
        cut[1:n] = space[1:] & ~space[:-1] & ~((data[:-1] >= 0x1C) & (data[:-1] <= 0x1F))
        wide = np.flatnonzero(cut[1:n] & (data[:-1] >= 0x80)) + 1
        two, three = data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
        cut[wide] = (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))
    cut[bounds] = True
    return np.flatnonzero(cut)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs that begin at ``starts``."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


def token_ids(
    data: np.ndarray, bounds: np.ndarray, name: str = TOKENIZER, special: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, number by row); each distinct chunk is tokenized once.

    SPECIAL strings are one id each if ``special``, else ordinary text.

    Chunks that begin with white space and end without it are tokenized in
    one string, since every border between them is a cut; the few others,
    at the ends of texts, one by one.
    """
    cuts = chunk_bounds(data, bounds)
    starts, ends = cuts[:-1], cuts[1:]
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
    encoder, widths = _tokenizer(name)
    allowed = set(SPECIAL) if special else set()
    encode = lambda text: np.array(encoder.encode(text, allowed_special=allowed, disallowed_special=()), np.uint32)
    _, at, which = np.unique(span_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
    first, last = starts[at], ends[at]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    plain = SPACE[data[first]] & ~edge[last] & ~edge[first]
    sizes = np.zeros(len(at), np.int64)
    size = (last - first)[plain]
    joined = data[_ragged(first[plain], size)].tobytes().decode("utf-8", "replace")
    flat = [encode(joined)]
    sizes[plain] = np.diff(np.append(-1, np.searchsorted(np.cumsum(widths[flat[0]]), np.cumsum(size))))
    rest = np.flatnonzero(~plain)
    for k in rest:
        flat.append(encode(data[first[k] : last[k]].tobytes().decode("utf-8", "replace")))
    sizes[rest] = [len(x) for x in flat[1:]]
    offsets = np.empty(len(at), np.int64)
    offsets[plain] = np.cumsum(sizes[plain]) - sizes[plain]
    offsets[rest] = len(flat[0]) + np.cumsum(sizes[rest]) - sizes[rest]
    each = sizes[which]
    ids = np.concatenate(flat)[_ragged(offsets[which], each)]
    row = np.append(0, np.cumsum(each))[np.searchsorted(starts, bounds)]
    return ids, np.diff(row)


class Index:
    """BM25 inverted index of one shard; ``terms`` holds the word hashes of each document."""

    def __init__(self, terms: list[np.ndarray]):
        n = self.n = len(terms)
        length = np.array([len(t) for t in terms], np.int64)
        every = np.concatenate(terms) if n else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        every, of = every[order], np.repeat(np.arange(n), length)[order]
        pair = np.flatnonzero(np.append(True, (every[1:] != every[:-1]) | (of[1:] != of[:-1]))[: len(every)])
        tf = np.diff(np.append(pair, len(every)))
        term, self.doc = every[pair], of[pair]
        self.start = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        self.stop = np.append(self.start[1:], len(term))[: len(self.start)]
        df = self.stop - self.start
        idf = np.repeat(np.log1p((n - df + 0.5) / (df + 0.5)), df)
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 0.0, 1.0))
        self.weight = idf * tf * (K1 + 1) / (tf + norm[self.doc])
        useful = np.repeat((df > 1) & (df <= max(2, COMMON * n)), df)
        doc, weight = self.doc[useful], self.weight[useful]
        order = np.lexsort((-weight, doc))
        self.query = np.repeat(np.arange(len(df)), df)[useful][order]
        self.bounds = np.searchsorted(doc[order], np.arange(n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents with a term of the seed's query, best first, ties in order of the shard."""
        terms = self.query[self.bounds[seed] : self.bounds[seed + 1]][:QUERY_TERMS]
        if not len(terms):
            return terms
        runs = [slice(self.start[t], self.stop[t]) for t in terms]
        score = np.bincount(
            np.concatenate([self.doc[r] for r in runs]),
            np.concatenate([self.weight[r] for r in runs]), minlength=self.n,
        )
        at = np.flatnonzero((score > 0) & unused)
        return at[np.argsort(-score[at], kind="stable")]


def fill(lengths: list[int], index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard.

    All sequences are full but the last, which is cut into powers of two.
    """
    unused = np.ones(len(lengths), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, used, following = 0, 0, 0
    near: Iterator[int] = iter(())
    left = len(lengths)
    while left:
        doc = next((d for d in near if unused[d]), None)
        if doc is None:
            while not unused[following]:
                following += 1
            doc = following
        unused[doc] = False
        left -= 1
        opens, start = used == 0, 0
        while start < lengths[doc]:
            take = min(window - used, lengths[doc] - start)
            pieces.append((doc, start, take, sequence, used))
            start, used = start + take, used + take
            if used == window:
                sequence, used, opens = sequence + 1, 0, True
        if opens and left:
            near = iter(index.neighbours(doc, unused).tolist())
    if used and used & (used - 1):
        tail = [p for p in pieces if p[3] == sequence]
        del pieces[len(pieces) - len(tail) :]
        room, at = 1 << (used.bit_length() - 1), 0
        for doc, start, length, _, _ in tail:
            while length:
                take = min(room - at, length)
                pieces.append((doc, start, take, sequence, at))
                start, length, at, used = start + take, length - take, at + take, used - take
                if at == room:
                    sequence, at = sequence + 1, 0
                    room = 1 << max(used.bit_length() - 1, 0)
    return pieces


def _pack(batches: Iterator[pa.RecordBatch], name: str, with_ids: bool, special: bool) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 40
    docs: list = []
    ids: list[np.ndarray] = []
    terms: list[np.ndarray] = []

    def shard() -> pa.RecordBatch:
        nonlocal sequence
        pieces = fill([len(x) for x in ids], Index(terms))
        parts = [ids[d][s : s + n] for d, s, n, _, _ in pieces]
        out = {
            "doc_id": pa.array([docs[p[0]] for p in pieces], pa.int64()),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
            "doc_tokens": pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([sequence + p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64()),
        }
        if with_ids:
            out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
        sequence += pieces[-1][3] + 1
        docs.clear(), ids.clear(), terms.clear()
        return pa.RecordBatch.from_pydict(out)

    held = 0
    for batch in batches:
        keys = batch.column("doc_id").to_pylist()
        for first, end, data, bounds in slices(batch.column("text"), SLICE):
            flat, counts = token_ids(data, bounds, name, special)
            hashes, sizes = words(data, bounds)
            a, b = np.cumsum(counts), np.cumsum(sizes)
            for k in range(end - first):
                docs.append(keys[first + k])
                ids.append(np.append(flat[a[k] - counts[k] : a[k]], np.uint32(END_ID)))
                terms.append(hashes[b[k] - sizes[k] : b[k]])
                held += len(ids[-1])
                if len(docs) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    yield shard()
                    held = 0
    if docs:
        yield shard()


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, with_ids: bool = False, special: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids are those of its text followed by END_ID; a null or
    empty text has END_ID alone. Every id lies in exactly one piece, and a
    sequence's pieces follow each other without gaps. Rows that repeat a
    doc_id, or have none, are documents of their own. Columns other than
    doc_id and text are not read. An empty table gives no rows.

    All sequences hold 2048 ids except the last of each shard, whose ids are
    dealt to sequences of falling powers of two, so nothing is padded.

    With ``special`` the ids are those of byte_bpe_50k.json as it stands, which
    reads <|endoftext|> as one id; else such strings are ordinary text.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: _pack(it, tokenizer, with_ids, special), schema + (", ids array<int>" if with_ids else "")
    )


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), special=True)
