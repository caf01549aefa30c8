"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from fieldhub.llm import conversations
from fieldhub.llm.four_russians import Blocks, before, normal

WHITE = " \t\n\x0b\f\r"
NONE = hashlib.sha256(b"").hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(faults, roles):
    """(cost, audit, roles of what stays, with the row's number or None), least first, by a shortest-path search."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if at == len(roles) and state in ("", "a"):
            return cost, audit, kept
        if (at, state, audit) in done:
            continue
        done.add((at, state, audit))
        grow = []
        for role in ("user", "assistant"):
            grow.append((2, "I", at, role[0], (role, None)))
        if at < len(roles):
            late = faults[at] == "truncated"
            grow.append((3, "D", at + 1, state, None))
            if faults[at] not in ("blank", "duplicate"):
                grow.append((late, "K", at + 1, roles[at][:1], (roles[at], at)))
                for role in ("user", "assistant"):
                    grow.append((2 + late, "R", at + 1, role[0], (role, at)))
        for more, edit, onward, after, turn in grow:
            if turn is not None and (not after or state + after not in ("s", "u", "su", "ua", "au")):
                continue
            if len(audit) < 3 * len(roles) + 4:
                heapq.heappush(heap, (cost + more, audit + edit, onward, after, kept + ((turn,) if turn else ())))
    raise AssertionError


def brute(rows, every):
    out = []
    for conv in {r[0] for r in every}:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                          "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit, kept = cheapest(faults, [r[2] for r in mine])
        lines = [f"{role}:{'' if at is None else mine[at][3]}" for role, at in kept]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_block_tables_equal_single_steps():
    draw = random.Random(0)
    tables = Blocks()
    assert len(tables.vectors) < 200
    for _ in range(500):
        at = draw.randrange(len(tables.vectors))
        symbols = [draw.randrange(8) for _ in range(tables.size)]
        vector = tables.vectors[at]
        for symbol in symbols:
            vector = before(vector, symbol)
        assert tables.vectors[tables.ahead(at, symbols)] == normal(vector)
        assert tables.inside(at, "".join(map(str, symbols))) == tables.ahead(at, symbols)


def random_rows():
    draw = random.Random(9)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Uncle", "steward"]
    texts = ["Yes.", "No", "What?", "", " \n", None, "Yes. ", "fine!\t", "é", "Long text here."]
    rows = []
    for conv in range(260):
        for turn in range(draw.randrange(9)):
            kind = draw.random()
            number = None if kind < 0.05 else turn - (kind > 0.9) + (kind > 0.8)
            rows.append((conv if conv else None, number, draw.choice(roles[: draw.choice([4, 10])]), f"{draw.choice(texts) or ''}{turn}." if draw.random() < 0.5 else draw.choice(texts)))
    rows += rows[:5]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    given = random_rows()
    return given, spark.createDataFrame([(*r, "x", 1) for r in given], "conv_id long, turn long, role string, text string, _role string, _end int")


def test_damage(rows):
    given, frame = rows
    assert sorted(map(repr, map(tuple, conversations.damaged(frame).collect()))) == sorted(map(repr, damage(given)))


def test_repair_equals_search(rows):
    given, frame = rows
    hurt = damage(given)
    got = conversations.repair(conversations.damaged(frame), frame)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(hurt, given)


def test_repair_without_damage(rows):
    given, frame = rows
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in given]
    assert sorted(map(tuple, conversations.repair(frame).collect()), key=repr) == brute(plain, plain)


def test_turns_of_the_repair(spark, rows):
    given, frame = rows
    turns = {}
    for r in conversations.repaired_turns(frame).collect():
        turns.setdefault(r["_conv"], []).append((r["_place"], f"{r['_role']}:{r['_text']}", r["_edit"]))
    for r in conversations.repair(frame).collect():
        mine = sorted(turns.get(r["_conv"], []))
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(t for _, t, _ in mine).encode()).hexdigest() == r["_sha"]
        assert [e for _, _, e in mine] == [e for e in r["_audit"] if e != "D"]


def test_long_conversation_and_empty_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(3000)] + [(1, 5000 + k, "user", "again.") for k in range(2000)]
    got = conversations.repair(spark.createDataFrame(rows, kind)).first()
    assert (got["_cost"], got["_audit"], got["_duplicate"], got["_gaps"]) == (3 * 1999 + 2, "K" * 3001 + "D" * 1999 + "I", 1999, 2000)
    none = spark.createDataFrame([], kind)
    assert conversations.repair(none).count() == 0
    assert conversations.repair(conversations.damaged(none), none).count() == 0
    assert conversations.repaired_turns(none).count() == 0
    gone = conversations.repair(none, spark.createDataFrame(rows[:1], kind)).first()
    assert tuple(gone) == (1, 0, 0, 0, 0, 0, 0, "", NONE)
