"""Cheapest repair of a conversation's roles, a block of turns at a time.

Roles run along a small machine: nothing yet, after a system turn, after a user turn, after an
assistant turn; only the first and the last may end a conversation.  A cost vector has, for each state,
the cheapest way through all turns that follow.  Less their minimum there are few of them, so the vector before a
block of turns is one lookup by the vector behind it and the block's symbols.
"""

from __future__ import annotations

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
SYMBOLS = 8  # 2 * class of the role (s, u, a, other) + 1 if truncated
BLOCK = 4

INSERT, REROLE, DELETE = 2, 2, 3  # costs

#: the state after an inserted or reroled turn, the only one that goes on from a state
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}

Vector = tuple[int, int, int, int]


def kept(state: int, symbol: int) -> int | None:
    """The state after keeping a turn, None where it may not follow."""
    role = symbol >> 1
    if role == 0:
        return SYSTEM if state == START else None
    return role + 1 if role < 3 and NEXT[state] == role + 1 else None


def before(after: Vector, symbol: int) -> Vector:
    """The vector before a turn that may stay, from the one behind it."""
    late = symbol & 1
    out = []
    for state in range(4):
        cost = min(DELETE + after[state], REROLE + late + after[NEXT[state]])
        keep = kept(state, symbol)
        out.append(cost if keep is None else min(cost, late + after[keep]))
    return inserted(out)


def inserted(costs: list[int]) -> Vector:
    """The costs with turns inserted first, where that is cheaper."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + user)
    user = min(user, INSERT + assistant)
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


def normal(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(cost - least for cost in costs)


class Blocks:
    """All normalised cost vectors, and the vector before every block of symbols."""

    def __init__(self, size: int = BLOCK):
        self.size = size
        end = inserted([0, 9, 9, 0])  # 9: over any way to the end
        self.vectors: list[Vector] = [normal(end)]
        known = {self.vectors[0]: 0}
        rows: list[list[int]] = []
        for vector in self.vectors:  # grows as new vectors are met
            row = []
            for symbol in range(SYMBOLS):
                met = normal(before(vector, symbol))
                if met not in known:
                    known[met] = len(self.vectors)
                    self.vectors.append(met)
                row.append(known[met])
            rows.append(row)
        self.one = np.array(rows)
        table = np.arange(len(self.vectors))[:, None]
        for _ in range(size):  # a code's digits are the symbols from the block's last to its first
            table = self.one[table].reshape(len(self.vectors), -1)
        self.block = table

    def ahead(self, vector: int, symbols: list[int]) -> int:
        """The vector before a block, from the one behind it; symbols from the last to the first."""
        code = 0
        for symbol in symbols:
            code = code * SYMBOLS + symbol
        return int(self.block[vector, code])

    def inside(self, vector: int, symbols: str) -> int:
        """The vector before a block's last turns, given from the last to the first."""
        for symbol in symbols:
            vector = int(self.one[vector, int(symbol)])
        return vector


def pick(state: int, symbol: int, here: Vector, after: Vector) -> tuple[str, int, int]:
    """(edit, next state, cost): the ASCII-least edit on a cheapest way; ``here`` and ``after`` are the
    costs before and behind the turn, less the same amount."""
    late, onward = symbol & 1, NEXT[state]
    if DELETE + after[state] == here[state]:
        return "D", state, DELETE
    if INSERT + here[onward] == here[state]:
        return "I", onward, INSERT
    keep = kept(state, symbol)
    if keep is not None and late + after[keep] == here[state]:
        return "K", keep, late
    return "R", onward, REROLE + late
