"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, modal,
filler, other). Small transducers follow targets, threats, negations and
reported speech through a clause; their composition gives every insult or
completed threat a factor, and the weights of a clause's matches add up.
Insults and their weights are learned from labels: words and word stems
whose documents are toxic far more often than chance allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.llm._letters import codes, letter_words, run_hashes
from gridpulse.llm._stage import stage
from gridpulse.llm._text import mix, slices
from gridpulse.llm.minhash_dedup import near_duplicates

#: Labelled rows that weights are learned from, those with the smallest hash of doc_id.
MOST_LABELLED = 30_000
#: Learned arcs, those of greatest significance.
MOST_ARCS = 50_000
STEMS = (4, 5, 6)
#: Share of toxic documents among those with a word, and with a stem, which speaks for many words.
LEAST_POSTERIOR, LEAST_STEM_POSTERIOR = 0.87, 0.97
BASE = -2.2
SEED_WEIGHT = 4.5
THREAT_WEIGHT = 5.0
MOST_EVIDENCE = 12.0
CUT = 0.3
OTHER, FILLER, NEGATION, REPORT, TARGET, MODAL, THREAT, INSULT = range(8)

#: Fixed word lists of the grammar.
WORDS = {
    FILLER: "a an the such so very really be is are am was were been being just quite that this like as",
    NEGATION: "not no never isn aren wasn weren don doesn didn nobody neither nicht kein keine pas jamais nunca",
    REPORT: "said says say told tells called calls wrote writes quoted claims claimed reported sagte dit dijo",
    TARGET: "you your yours yourself him her them his their he she they us me people du dich ihr toi vous tu usted",
    MODAL: "will shall gonna going would must should ll werde vais voy",
    THREAT: "kill hurt destroy murder beat smash strangle stab shoot burn crush attack",
    INSULT: "idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown fool imbecile jerk",
}
_CLAUSE = np.zeros(0x110000, bool)
_CLAUSE[[ord(c) for c in ".!?;:\n"]] = True


@dataclass
class Transducer:
    """States are small numbers; ``moves`` gives (state, symbol) -> (state, output); else state 0, no output."""

    moves: dict[tuple[int, int], tuple[int, str | None]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, str | None]:
        return self.moves.get((state, symbol), (0, None))


def _countdown(start: int, span: int, emit_on: dict[int, str], hold: tuple[int, ...] = (), through: bool = True) -> Transducer:
    """Opens on ``start`` for ``span`` symbols; emits on the symbols of ``emit_on`` while open."""
    t = Transducer()
    for symbol in range(8):
        for state in range(span + 1):
            out = emit_on.get(symbol) if state else None
            if symbol == start:
                t.moves[state, symbol] = (span, out)
            elif state and symbol in hold:
                t.moves[state, symbol] = (state, out)
            elif state and (through or out):
                t.moves[state, symbol] = (state - 1, out)
    return t


def grammar() -> tuple[Transducer, ...]:
    return (
        _countdown(TARGET, 4, {INSULT: "aimed"}),
        _countdown(NEGATION, 2, {INSULT: "denied", THREAT: "denied"}, hold=(FILLER, MODAL), through=False),
        _countdown(REPORT, 5, {INSULT: "reported", THREAT: "reported"}, hold=(FILLER, TARGET)),
        _countdown(THREAT, 2, {TARGET: "threat"}, hold=(FILLER,)),
        _countdown(MODAL, 2, {THREAT: "meant"}, hold=(FILLER,)),
    )


FACTORS = {"aimed": 1.25, "denied": 0.1, "reported": 0.2}


class Composed:
    """Product of transducers; its states are found as they are reached and kept."""

    def __init__(self, parts: tuple[Transducer, ...]):
        self.parts = parts
        self.cache: dict = {}

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], frozenset[str]]:
        key = state, symbol
        if key not in self.cache:
            moved = [t.step(s, symbol) for t, s in zip(self.parts, state)]
            self.cache[key] = tuple(m[0] for m in moved), frozenset(m[1] for m in moved if m[1])
        return self.cache[key]

    def clause(self, symbols: list[int], weights: list[float]) -> float:
        """Weight of the matches of one clause; a threat takes the outputs seen at its verb."""
        state, total, threat = (0,) * len(self.parts), 0.0, 0.0
        for symbol, weight in zip(symbols, weights):
            state, out = self.step(state, symbol)
            factor = 1.0
            for name in out:
                factor *= FACTORS.get(name, 1.0)
            if symbol == INSULT:
                total += weight * factor
            elif symbol == THREAT:
                threat = THREAT_WEIGHT * factor * (1.25 if "meant" in out else 0.8)
            elif "threat" in out:
                total += threat
                threat = 0.0
        return total


@dataclass(frozen=True)
class Lexicon:
    """Learned arcs: hashes of words (kind 0) and of stems (kind: letters), sorted, with weights."""

    arcs: dict[int, tuple[np.ndarray, np.ndarray]]


def _word_hash(word: str) -> int:
    points = np.array([ord(c) for c in word], np.uint32)
    h = np.zeros(1, np.uint64)
    for x in points:
        h = mix(h * np.uint64(0x9E3779B97F4A7C55) + np.uint64(x))
    return int(h[0])


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    points, at = codes(data, bounds)
    lower, starts, ends, row = letter_words(points, at)
    clause = np.cumsum(_CLAUSE[points])[starts] if len(starts) else starts
    return lower, starts, ends, row, clause


def _forms(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, token positions, hashes): whole words, then stems of longer words."""
    yield 0, np.arange(len(starts)), run_hashes(lower, starts, ends)
    for size in STEMS:
        at = np.flatnonzero(ends - starts > size)
        yield size, at, run_hashes(lower, starts[at], starts[at] + size)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word or stem by label, counted per slice."""
    for batch in batches:
        toxic = np.array(batch.column("label").to_pylist(), np.int64)
        for first, end, data, bounds in slices(batch.column("text")):
            lower, starts, ends, row, _ = _tokens(data, bounds)
            for kind, at, hashes in _forms(lower, starts, ends):
                pair = np.unique(hashes ^ mix(row[at].astype(np.uint64) + np.uint64(1)), return_index=True)[1]
                term, which = np.unique(hashes[pair], return_inverse=True)
                bad = np.bincount(which, toxic[first:end][row[at][pair]], minlength=len(term))
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array(np.full(len(term), kind, np.int64)),
                        "term": pa.array(term.view(np.int64)),
                        "toxic": pa.array(bad.astype(np.int64)),
                        "n": pa.array(np.bincount(which, minlength=len(term)).astype(np.int64)),
                    }
                )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _without_copies(sample: DataFrame) -> DataFrame:
    """(label, text) of one row, that of the smallest doc_id, of each label and group of near-duplicates.

    Copies, edited ones too, would lend weight to chance words.
    """
    sample = stage(sample.select(F.monotonically_increasing_id().alias("row"), "doc_id", "label", "text"), "toxicity")
    groups = near_duplicates(sample.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = (
        sample.select("row", "label", F.struct("doc_id", F.xxhash64("text").alias("text"), "row").alias("rank")).join(groups, "row")
        .groupBy("label", "component_id").agg(F.min("rank").alias("first")).select("first.row")
    )
    return sample.join(broadcast_if_small(stage(first, "toxicity")), "row", "left_semi").select("label", "text")


def learn(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Lexicon:
    """Arcs from at most ``most`` labelled rows that are not held out.

    Of near-duplicate texts with a label one is counted, that of the
    smallest doc_id; all counts are of these rows. A term is an insult when
    a likelihood-ratio test at the level of one false term among all of them
    finds its documents more toxic than the rest, and enough of them are.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("long").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    learned: dict[int, list[tuple[int, float]]] = {}
    n = bad = 0
    if 0 < total["bad"] < total["n"]:
        sample = _without_copies(documents.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
        total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
        n, bad = total["n"], total["bad"]
    if 0 < bad < n:
        terms = (
            sample.mapInArrow(_term_counts, "kind long, term long, toxic long, n long")
            .groupBy("kind", "term").agg(F.sum("toxic").alias("a"), F.sum("n").alias("m")).where("m >= 3 and a >= 2")
        )
        rate = bad / n
        a, b = F.col("a").cast("double"), (F.col("m") - F.col("a")).cast("double")
        gain = 2 * (
            F.when(a > 0, a * F.log(a / (F.col("m") * rate))).otherwise(0.0)
            + F.when(b > 0, b * F.log(b / (F.col("m") * (1 - rate)))).otherwise(0.0)
        )
        weight = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (n - bad + 1))
        surely = 1 / (1 + F.exp(-(weight + math.log(bad / (n - bad)))))
        rows = (
            terms.withColumn("gain", gain).withColumn("weight", weight)
            .where((a > F.col("m") * rate) & (surely >= F.when(F.col("kind") == 0, LEAST_POSTERIOR).otherwise(LEAST_STEM_POSTERIOR)))
            .where(F.col("gain") >= 2 * math.log(max(n, 2) * 10))
            .orderBy(F.desc("gain"), "kind", "term").limit(MOST_ARCS).collect()
        )
        for r in rows:
            learned.setdefault(r["kind"], []).append((r["term"], r["weight"]))
    arcs = {}
    for kind, found in learned.items():
        terms = np.array([t for t, _ in found], np.int64).view(np.uint64)
        order = np.argsort(terms)
        arcs[kind] = terms[order], np.array([w for _, w in found])[order]
    return Lexicon(arcs)


def _look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    terms, values = table
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, values[at], 0)


def scores(data: np.ndarray, bounds: np.ndarray, lexicon: Lexicon, machine: Composed, symbols: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probability-like score of every row of a slice."""
    lower, starts, ends, row, clause = _tokens(data, bounds)
    evidence = np.zeros(len(bounds) - 1)
    if len(starts):
        weight = np.zeros(len(starts))
        symbol = None
        for kind, at, hashes in _forms(lower, starts, ends):
            if kind == 0:
                symbol = _look_up(symbols, hashes).astype(np.int64)
                weight[symbol == INSULT] = SEED_WEIGHT
            if kind in lexicon.arcs:
                weight[at] = np.maximum(weight[at], _look_up(lexicon.arcs[kind], hashes))
        symbol[weight > 0] = INSULT
        marked = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
        lows, highs = np.searchsorted(clause, marked), np.searchsorted(clause, marked, "right")
        for low, high in zip(lows.tolist(), highs.tolist()):
            evidence[row[low]] += machine.clause(symbol[low:high].tolist(), weight[low:high].tolist())
    return 1 / (1 + np.exp(-(BASE + np.minimum(evidence, MOST_EVIDENCE))))


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    machine = Composed(grammar())
    named = sorted((_word_hash(w), kind) for kind, words in WORDS.items() for w in words.split())
    symbols = np.array([h for h, _ in named], np.uint64), np.array([k for _, k in named], float)
    for batch in batches:
        for first, end, data, bounds in slices(batch.column("text")):
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")[first:end], "score": pa.array(scores(data, bounds, lexicon, machine, symbols))}
            )


def judged(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null, empty and wordless texts have the base score, which is below the
    cut. Repeated rows are scored each. Columns other than doc_id and text
    are not read. An empty table gives no rows.
    """
    found = documents.select("doc_id", "text").mapInArrow(
        lambda it: _score(it, lexicon), f"doc_id {dict(documents.dtypes)['doc_id']}, score double"
    )
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(documents, learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
