"""Cheapest repair of damaged conversations, by divide and conquer.

A conversation is read as one pass through four states: nothing yet, after
system, after user, after assistant. Every row is a transfer between states
with the cheapest edits for each pair; transfers of neighbouring rows
combine into one of a block. Forward costs from the state before a block
and backward costs from the state after it meet at its middle, where the
cheapest crossing (the least audit among equals) is chosen; both halves
follow the same way, so no table of all rows is kept.

Rows are ranged over tasks by conversation and turn. Conversations that lie
inside a task are repaired there. Those that a task's border or the size
bound cuts leave pieces with their transfer; the states between pieces are
then found from the transfers alone, and the pieces are repaired apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.llm._stage import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: More for a truncated row that stays.
TRUNCATED = 3
#: States by the last role's initial; the role that must follow each state.
STATES = ["", "s", "u", "a"]
FOLLOWS = {0: 2, 1: 2, 2: 3, 3: 2}
ROLES = {2: "user", 3: "assistant"}
#: Initials of neighbours that may follow each other.
LEGAL = {"su", "ua", "au"}
#: Inserted rows after the last one, by state.
CLOSING = [0, 2, 1, 0]
NEVER = 1 << 60
#: Rows and bytes of text of a piece at most (one row more may begin in it).
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 22


class Transfer(NamedTuple):
    """cost[4 * p + q] from state p to q, and the place of its edits in ASCII order among those from p."""

    cost: tuple[int, ...]
    place: tuple[int, ...]


class Kind(NamedTuple):
    """What the edits of a row depend on: its initial (None for others), truncation, a required deletion."""

    initial: str | None
    truncated: bool
    forced: bool


def _edits(kind: Kind, before: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edits, state) of a row in a state: up to two rows inserted before it, then its own edit."""
    state = before
    for inserted in range(3):
        cost, made = inserted * COSTS[INSERT], INSERT * inserted
        yield cost + COSTS[DELETE], made + DELETE, state
        if not kind.forced:
            more = TRUNCATED if kind.truncated else 0
            after = FOLLOWS[state]
            yield cost + COSTS[REROLE] + more, made + REROLE, after
            if kind.initial == STATES[after] or kind.initial == "s" and state == 0:
                yield cost + COSTS[KEEP] + more, made + KEEP, STATES.index(kind.initial)
        state = FOLLOWS[state]


def _ranked(keys: list, cost: list[int]) -> tuple[int, ...]:
    """Place of every reachable target among those from the same state."""
    out = []
    for p in range(4):
        own = sorted(k for k, c in zip(keys[4 * p : 4 * p + 4], cost[4 * p : 4 * p + 4]) if c < NEVER)
        out += [own.index(k) if c < NEVER else 9 for k, c in zip(keys[4 * p : 4 * p + 4], cost[4 * p : 4 * p + 4])]
    return tuple(out)


def _table(kind: Kind) -> tuple[Transfer, list[str]]:
    """A row's transfer and the edits of each pair of states."""
    best: list[tuple[int, str]] = [(NEVER, "")] * 16
    for p in range(4):
        for cost, made, q in _edits(kind, p):
            best[4 * p + q] = min(best[4 * p + q], (cost, made))
    cost, edits = [c for c, _ in best], [e for _, e in best]
    return Transfer(tuple(cost), _ranked(edits, cost)), edits


KINDS = [Kind(i, t, False) for i, t in product(["s", "u", "a", None], [False, True])] + [Kind(None, False, True)]
TABLES = [_table(k) for k in KINDS]
FORCED = len(KINDS) - 1


class Row(NamedTuple):
    """Equal rows of a turn: all but the first are duplicates."""

    role: str
    text: str
    copies: int
    fault: str | None

    @property
    def kind(self) -> int:
        if self.fault in ("blank", "duplicate"):
            return FORCED
        return KINDS.index(Kind(self.role[:1] if self.role[:1] in ("s", "u", "a") else None, self.fault == "truncated", False))

    def transfer(self) -> Transfer:
        own = TABLES[self.kind][0]
        more = COSTS[DELETE] * (self.copies - 1)
        return own if not more else Transfer(tuple(min(c + more, NEVER) for c in own.cost), own.place)


def joined(a: Transfer, b: Transfer) -> Transfer:
    """Transfer of a block followed by another."""
    cost, keys = [], []
    for p in range(0, 16, 4):
        for q in range(4):
            least, place, m = min((a.cost[p + m] + b.cost[4 * m + q], a.place[p + m], m) for m in range(4))
            cost.append(min(least, NEVER))
            keys.append((place, b.place[4 * m + q]))
    return Transfer(tuple(cost), _ranked(keys, cost))


def _forward(parts: list[Transfer], state: int) -> tuple[list[int], list[int]]:
    """Costs and places of the four states after ``parts``."""
    cost = [0 if q == state else NEVER for q in range(4)]
    place = [0] * 4
    for t in parts:
        best = [
            min((cost[m] + t.cost[4 * m + q], place[m], t.place[4 * m + q]) for m in range(4)) for q in range(4)
        ]
        order = sorted(x[1:] for x in best if x[0] < NEVER)
        cost = [min(x[0], NEVER) for x in best]
        place = [order.index(x[1:]) if x[0] < NEVER else 9 for x in best]
    return cost, place


def _backward(parts: list[Transfer], state: int) -> list[int]:
    """Costs from each of the four states before ``parts`` to ``state`` after them."""
    cost = [0 if q == state else NEVER for q in range(4)]
    for t in reversed(parts):
        cost = [min(NEVER, *(t.cost[4 * p + q] + cost[q] for q in range(4))) for p in range(4)]
    return cost


def crossings(parts: list[Transfer], before: int, after: int) -> list[int]:
    """States after each part on the cheapest way from ``before`` to ``after``, the least audit among equals."""
    if len(parts) <= 1:
        return [after] * len(parts)
    half = len(parts) // 2
    cost, place = _forward(parts[:half], before)
    rest = _backward(parts[half:], after)
    middle = min(range(4), key=lambda m: (cost[m] + rest[m], place[m]))
    return crossings(parts[:half], before, middle) + crossings(parts[half:], middle, after)


def last_state(parts: list[Transfer]) -> tuple[int, int]:
    """(cheapest cost of all, state after the last row)."""
    cost, place = _forward(parts, 0)
    cost = [c + COSTS[INSERT] * n for c, n in zip(cost, CLOSING)]
    state = min(range(4), key=lambda q: (cost[q], place[q]))
    return cost[state], state


def _inserted(state: int, edit_count: int) -> list[tuple[str, str, str]]:
    out = []
    for _ in range(edit_count):
        state = FOLLOWS[state]
        out.append((INSERT, ROLES[state], ""))
    return out


def repaired(rows: list[Row], before: int, after: int, closing: bool) -> tuple[str, list[tuple[str, str, str]]]:
    """(audit, lines (edit, role, text) that remain) between two states; ``closing`` completes the last exchange."""
    audit: list[str] = []
    lines: list[tuple[str, str, str]] = []
    state = before
    for row, then in zip(rows, crossings([r.transfer() for r in rows], before, after)):
        edits = TABLES[row.kind][1][4 * state + then]
        lines += _inserted(state, len(edits) - 1)
        if edits[-1] == KEEP:
            lines.append((KEEP, row.role, row.text))
        elif edits[-1] == REROLE:
            lines.append((REROLE, ROLES[then], row.text))
        audit += [edits, DELETE * (row.copies - 1)]
        state = then
    if closing:
        lines += _inserted(state, CLOSING[state])
        audit.append(INSERT * CLOSING[state])
    return "".join(audit), lines


COUNTED = ["blank", "duplicate", "truncated", "illegal"]


def _counts(rows: list[Row], turns: list[int | None]) -> dict:
    """Counts of a run of rows, with what joins it to its neighbours."""
    out = {k: sum(r.fault == k for r in rows) for k in COUNTED[:3]}
    more = sum(r.copies - 1 for r in rows)
    out["blank"] += sum(r.copies - 1 for r in rows if r.fault == "blank")
    out["duplicate"] += more - sum(r.copies - 1 for r in rows if r.fault == "blank")
    initials = [r.role[:1] for r in rows]
    out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + more
    known = [t for t in turns if t is not None]
    out |= {
        "first_initial": initials[0], "last_initial": initials[-1], "turns": len(set(known)),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
    }
    return out


def _totals(parts: list[dict]) -> dict:
    """Counts of a conversation from those of its runs in order."""
    out = {k: sum(p[k] for p in parts) for k in COUNTED}
    out["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(parts, parts[1:]))
    turned = [p for p in parts if p["turns"]]
    distinct = sum(p["turns"] for p in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
    out["gaps"] = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0
    return out


LINES = "array<struct<edit:string,role:string,text:string>>"
TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
PIECE = (
    "piece long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, "
    "costs array<long>, places array<int>, rows array<struct<role:string,text:string,copies:long,fault:string>>"
)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow_schema(id_type: pa.DataType) -> pa.Schema:
    line = pa.list_(pa.struct([(k, pa.string()) for k in ("edit", "role", "text")]))
    row = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("fault", pa.string())]))
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return pa.schema(
        [("conv_id", id_type), *((k, pa.int64()) for k in longs), ("audit", pa.string()), ("lines", line)]
        + [(k, pa.int64()) for k in ("piece", "turns", "first_turn", "last_turn")]
        + [("first_initial", pa.string()), ("last_initial", pa.string()), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("rows", row)]
    )


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations repaired, and pieces of those that may be cut, from rows in order."""
    number = TaskContext.get().partitionId() << 32
    schema = None
    out: list[dict] = []
    rows: list[Row] = []
    turns: list[int | None] = []
    now, size, cut, begun = None, 0, True, False

    def piece() -> dict:
        nonlocal number
        number += 1
        whole = rows[0].transfer()
        for r in rows[1:]:
            whole = joined(whole, r.transfer())
        return _counts(rows, turns) | {
            "conv_id": now, "piece": number, "costs": whole.cost, "places": whole.place, "rows": [r._asdict() for r in rows],
        }

    def conversation() -> dict:
        cost, after = last_state([r.transfer() for r in rows])
        audit, lines = repaired(rows, 0, after, True)
        return _totals([_counts(rows, turns)]) | {
            "conv_id": now, "cost": cost, "audit": audit, "lines": [dict(zip(("edit", "role", "text"), x)) for x in lines],
        }

    for batch in batches:
        schema = schema or _arrow_schema(batch.schema.field("conv_id").type)
        columns = (batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "copies", "fault"))
        for conv, turn, role, text, copies, fault in zip(*columns):
            if begun and (conv != now or len(rows) >= PIECE_ROWS or size >= PIECE_BYTES):
                whole = conv != now and not cut
                out.append(conversation() if whole else piece())
                cut = conv == now
                rows, turns, size = [], [], 0
            now, begun = conv, True
            rows.append(Row(role, text, copies, fault))
            turns.append(turn)
            size += len(text)
            if len(out) >= 256:
                yield _batch(out, schema)
                out = []
    if rows:
        out.append(piece())
    if out:
        yield _batch(out, schema)


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every piece the states before and after it and its conversation's totals, from transfers in order."""
    held: list[dict] = []

    def marks() -> pa.RecordBatch:
        parts = [Transfer(tuple(p["costs"]), tuple(p["places"])) for p in held]
        cost, after = last_state(parts)
        states = crossings(parts, 0, after)
        totals = _totals(held) | {"cost": cost}
        rows = [
            totals | {"piece": p["piece"], "before": a, "after": b, "last": p is held[-1]}
            for p, a, b in zip(held, [0, *states], states)
        ]
        schema = [("piece", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]
        schema += [(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return _batch(rows, pa.schema(schema))

    for batch in batches:
        for p in batch.to_pylist():
            if held and p["conv_id"] != held[0]["conv_id"]:
                yield marks()
                held = []
            held.append(p)
    if held:
        yield marks()


def _third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces repaired between their states: (piece, audit, lines)."""
    schema = _arrow_schema(pa.int64())
    schema = pa.schema([schema.field(k) for k in ("piece", "audit", "lines")])
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            rows = [Row(**r) for r in p["rows"]]
            audit, lines = repaired(rows, p["before"], p["after"], p["last"])
            out.append({"piece": p["piece"], "audit": audit, "lines": [dict(zip(("edit", "role", "text"), x)) for x in lines]})
        yield _batch(out, schema)


def faulty_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): equal rows of a turn once, with the first fault of the first of them."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    unended = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = (
        conversations.groupBy("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        .agg(F.count("*").alias("copies"))
        .withColumn("print", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    )
    rows = stage(rows, "turns")
    first = (
        rows.groupBy("conv_id", "print")
        .agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("unnumbered"))
        .where((F.col("low") < F.col("high")) | (F.col("unnumbered") & F.col("low").isNotNull()))
        .select(F.col("conv_id").alias("of"), F.col("print").alias("same"), "low", "unnumbered")
    )
    first = broadcast_if_small(stage(first, "turns"))
    seen = F.coalesce(F.col("turn").isNotNull() & F.col("unnumbered") | (F.col("turn") > F.col("low")), F.lit(False))
    fault = F.when(blank, "blank").when(seen, "duplicate").when(unended, "truncated")
    return rows.join(first, rows["conv_id"].eqNullSafe(first["of"]) & (rows["print"] == first["same"]), "left").select(
        "conv_id", "turn", "role", "text", "copies", fault.alias("fault")
    )


def repaired_pieces(conversations: DataFrame) -> DataFrame:
    """(conv_id, totals, audit, lines, piece): a row per conversation, or one per piece of those that were cut.

    Pieces have numbers in the order of their rows and share their
    conversation's totals; piece is null where the row is the conversation.
    """
    id_type = dict(conversations.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role", "text"]
    ranged = faulty_rows(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    first = stage(
        ranged.mapInArrow(_first_pass, f"conv_id {id_type}, {TOTALS}, audit string, lines {LINES}, {PIECE}"), "turns"
    )
    pieces = first.where("piece is not null")
    marks = stage(
        pieces.select(
            "conv_id", "piece", *COUNTED, "turns", "first_turn", "last_turn", "first_initial", "last_initial", "costs", "places"
        )
        .repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        .mapInArrow(_second_pass, f"piece long, before int, after int, last boolean, {TOTALS}"),
        "turns",
    )
    mended = (
        pieces.select("piece", "rows").join(marks.select("piece", "before", "after", "last"), "piece")
        .mapInArrow(_third_pass, f"piece long, audit string, lines {LINES}")
    )
    columns = ["conv_id", "gaps", *COUNTED, "cost", "audit", "lines", "piece"]
    cut = pieces.select("conv_id", "piece").join(marks, "piece").join(mended, "piece").select(*columns)
    return first.where("piece is null").select(*columns).unionByName(cut)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order; texts run through the digest and are not kept."""
    held, audit, digest, begun = None, [], hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        names = ["conv_id", "gaps", *COUNTED, "cost"]
        values = [held.column(k) for k in names]
        return pa.RecordBatch.from_arrays(
            [*values, pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], [*names, "audit", "repaired_sha256"]
        )

    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            if held is not None and one.column("conv_id")[0] != held.column("conv_id")[0]:
                yield row()
                audit, digest, begun = [], hashlib.sha256(), False
            held = one
            audit.append(one.column("audit")[0].as_py())
            if one.column("filled")[0].as_py():
                digest.update((b"\n" if begun else b"") + one.column("repaired")[0].as_py().encode())
                begun = True
    if held is not None:
        yield row()


def _joined_lines() -> Column:
    return F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, then by role and text. A null role
    or text is one space; a null conv_id is a conversation. A role without
    an initial fits nowhere. Repeated rows follow each other, all but the
    first duplicates. Texts of any length are read whole. Extra columns are
    not read. An empty table gives no rows. ``repaired_rows`` has the rows.
    """
    id_type = dict(conversations.dtypes)["conv_id"]
    pieces = repaired_pieces(conversations)
    columns = ["conv_id", "gaps", *COUNTED, "cost", "audit"]
    whole = pieces.where("piece is null").select(*columns, F.sha2(_joined_lines(), 256).alias("repaired_sha256"))
    cut = (
        pieces.where("piece is not null")
        .select(*columns, _joined_lines().alias("repaired"), (F.size("lines") > 0).alias("filled"), "piece")
        .repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        .mapInArrow(_digests, f"conv_id {id_type}, {TOTALS}, audit string, repaired_sha256 string")
    )
    return whole.unionByName(cut)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, position, edit, role, text) of the rows after repair, in order of piece and position."""
    return repaired_pieces(conversations).select(
        "conv_id", "piece", F.posexplode("lines").alias("position", "line")
    ).select("conv_id", "piece", "position", "line.edit", "line.role", "line.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the contract's damage, by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its end marks, 3 repeats
    it, 4 makes it a user's; nulls are one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text, role = text_of("text"), text_of("role")
    return (
        conversations.withColumn("corpus_harm", harm).where("corpus_harm <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("corpus_harm") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("corpus_harm") == 1, "").when(F.col("corpus_harm") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("corpus_harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "of")
    ids = rows.select("conv_id").distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTED, "cost")]
    return ids.join(found, ids["conv_id"].eqNullSafe(found["of"]), "left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


#: The definition: every row extends the cheapest, least edits of each state (cost, audit, lines compare in this order).
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes
  FROM conversations),
harmed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)
    ), 4294967295) % 20 AS harm FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM harmed WHERE harm <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, left(role, 1) AS initial FROM damaged),
rows AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows GROUP BY conv_id),
steps AS (
  SELECT * FROM (VALUES
    ('', '', '', []::VARCHAR[]), ('', 'I', 'u', ['user:']), ('', 'II', 'a', ['user:', 'assistant:']),
    ('s', '', 's', []), ('s', 'I', 'u', ['user:']), ('s', 'II', 'a', ['user:', 'assistant:']),
    ('u', '', 'u', []), ('u', 'I', 'a', ['assistant:']), ('a', '', 'a', []), ('a', 'I', 'u', ['user:'])) t(before, inserts, here, added)),
edits AS (
  SELECT before, inserts, added, op, here, CASE WHEN here = 'u' THEN 'a' ELSE 'u' END AS next,
    3 * length(inserts) + CASE op WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END AS cost
  FROM steps, (VALUES ('D'), ('K'), ('R')) o(op)),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counted
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT r.conv_id, r.i, CASE WHEN op = 'D' THEN e.here WHEN op = 'K' AND r.initial = 's' THEN 's' ELSE e.next END AS state,
      {'cost': w.best.cost + e.cost + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
       'audit': w.best.audit || inserts || op,
       'lines': w.best.lines || added || CASE op WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
         ELSE [CASE WHEN e.next = 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END} AS best
    FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN edits e ON e.before = w.state
    WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR r.initial = e.next OR r.initial = 's' AND e.here = ''))
  GROUP BY conv_id, i, state),
ended AS (
  SELECT c.conv_id, min({'cost': best.cost + CASE state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END,
      'audit': best.audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
      'lines': best.lines || CASE state WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END}) AS best
  FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n GROUP BY c.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
