"""Repair of conversations against every possible edit."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from gridpulse.llm import conversation_repair as repair

WANTED = re.compile(r"(s?(ua)+)?\Z")
BEGUN = re.compile(r"s?(ua)*u?\Z")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """First fault of every (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        marks = VISIBLE.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else None if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired text) by trying all edits, without states or blocks."""
    found = faults(rows)
    best = [None]

    def extend(i, cost, audit, initials, lines):
        if best[0] and cost > best[0][0] or not BEGUN.match(initials):
            return
        if i == len(rows) and WANTED.match(initials):
            made = (cost, audit, "\n".join(lines))
            best[0] = min(best[0] or made, made)
        if i < len(rows):
            _, role, text = rows[i]
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] == "truncated" else 0
                if role:
                    extend(i + 1, cost + more, audit + "K", initials + role[0], [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    extend(i + 1, cost + 3 + more, audit + "R", initials + new[0], [*lines, f"{new}:{text}"])
            extend(i + 1, cost + 4, audit + "D", initials, lines)
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                extend(i, cost + 3, audit + "I", initials + role[0], [*lines, f"{role}:"])

    extend(0, 0, "", "", [])
    return best[0]


def want(rows):
    """The digest columns of a conversation's (turn, role, text) rows in any order."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marks = faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, text = cheapest(rows)
    return (
        gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def parts(rows):
    """Units of an ordered conversation, copies together."""
    out = []
    for (turn, role, text), fault in zip(rows, faults(rows)):
        if out and out[-1][0] == (turn, role, text):
            out[-1][1] = out[-1][1]._replace(copies=out[-1][1].copies + 1)
        else:
            out.append([(turn, role, text), repair.Row(role, text, 1, fault)])
    return [u for _, u in out]


ROLE = st.sampled_from(["user", "assistant", "system", "tool", ""])
TEXT = st.sampled_from(["Yes.", "no", "Why? ", " ", "", "Yes."])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=5))
@example([("system", "a"), ("system", "b"), ("user", "c"), ("user", "d")])
def test_edits_against_all_edits(rows):
    rows = [(k, r, t) for k, (r, t) in enumerate(rows)]
    units = parts(rows)
    cost, after = repair.last_state([u.transfer() for u in units])
    audit, lines = repair.repaired(units, 0, after, True)
    assert (cost, audit, "\n".join(f"{r}:{t}" for _, r, t in lines)) == cheapest(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), min_size=2, max_size=30), st.data())
def test_blocks_join_to_the_same_way(rows, data):
    units = parts([(k, r, t) for k, (r, t) in enumerate(rows)])
    whole = repair.crossings([u.transfer() for u in units], 0, repair.last_state([u.transfer() for u in units])[1])
    cuts = sorted({0, len(units), *data.draw(st.lists(st.integers(1, len(units)), max_size=4))})
    blocks = []
    for a, b in zip(cuts, cuts[1:]):
        made = units[a].transfer()
        for u in units[a + 1 : b]:
            made = repair.joined(made, u.transfer())
        blocks.append(made)
    states = repair.crossings(blocks, 0, repair.last_state(blocks)[1])
    assert states == [whole[b - 1] for b in cuts[1:]]


def conversations():
    import random

    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["Fine.", "cut", "", None, "What?\n", f"own {t}!"])))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (70, None, "user", "A."), (70, None, "user", "A."), (71, 5, "user", "long " * 300_000)]


def check(spark, rows, expected):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, cost int")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df.repartition(3)).collect()}
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    assert got == {c: expected(r) for c, r in by.items()}


def test_conversations_against_all_edits(spark):
    check(spark, conversations(), want)


def long_conversation(n):
    roles = ["user", "assistant", "user", "user", "assistant", "tool", "system"]
    rows = [(k // 2, roles[k * k % 7], ["Yes.", "no end", "", f"own {k}.", f"own {k // 3}."][k * 3 % 5]) for k in range(n)]
    return rows + [(9, "user", "Same again.")] * 40


def stepwise(rows):
    """Row by row over the states, with the audits themselves: no places, no blocks."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    marks = faults(rows)
    best = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, marks):
        step = {}
        kind = repair.Kind(None, False, True) if fault in ("blank", "duplicate") else repair.Kind(role[:1] if role[:1] in "sua" else None, fault == "truncated", False)
        for p, (cost, audit, lines) in best.items():
            for c, made, q in repair._edits(kind, p):
                added = tuple(f"{r}:" for _, r, _ in repair._inserted(p, len(made) - 1))
                if made[-1] != "D":
                    added += (f"{role}:{text}",) if made[-1] == "K" else (f"{repair.ROLES[q]}:{text}",)
                new = (cost + c, audit + made, lines + added)
                step[q] = min(step.get(q, new), new)
        best = step
    ends = [(c + 3 * repair.CLOSING[q], a + "I" * repair.CLOSING[q], x + tuple(f"{r}:" for _, r, _ in repair._inserted(q, repair.CLOSING[q]))) for q, (c, a, x) in best.items()]
    cost, audit, lines = min(ends)
    turns = [t for t, _, _ in rows]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)), *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def test_a_conversation_longer_than_pieces_and_tasks(spark):
    rows = [(1, *r) for r in long_conversation(20_000)] + [(c, 0, "user", f"Hi {c}.") for c in range(2, 40)]
    check(spark, rows, stepwise)


def test_repaired_rows_follow_the_pattern(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {}
    for r in repair.repaired_rows(df).orderBy("piece", "position").collect():
        by.setdefault(r["conv_id"], []).append(r)
    assert all(WANTED.match("".join(x["role"][:1] for x in r)) for r in by.values())
    assert {x["edit"] for r in by.values() for x in r} == {"K", "R", "I"}


def test_damage_and_empty_tables(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Line {c}. Really? Yes! {t}.") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    harmed = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            harmed += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == {c for c, *_ in rows}
    for c in got:
        own = [r[1:] for r in harmed if r[0] == c]
        assert got[c] == (want(own) if own else none)
    assert repair.repair(df.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [[(0, "user", "a.")], [(0, "system", "a.")], [(0, "assistant", "a")], [(0, "user", "")]])
def test_single_rows(rows):
    units = parts(rows)
    assert repair.last_state([u.transfer() for u in units])[0] == cheapest(rows)[0]
