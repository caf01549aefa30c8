"""Conversation structure repair with Four-Russians block tables.

A turn's first fault counts: blank, duplicate (role and text seen earlier in the conversation),
truncated.  Blank and duplicate turns have to go, which costs the same in every state, so they
change no cost vector and stay out of the blocks.  What is left is one light row per different
(conversation, role, text), which an aggregation finds.

Two streams over sorted rows follow, both with constant memory however long a conversation is.
The first reads the light rows from the last turn to the first and looks up the vector before
every block of ``BLOCK`` turns; each row is told the vector behind its block and the block's
turns in between.  The second reads all turns in order, expands a row's block backward from that vector to
the row, so that ties are known, and takes the ASCII-least of the cheapest edits.  Texts are
shuffled once.  One conversation is read by one task, as its digest is one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub.llm.common import slices
from fieldhub.llm.four_russians import DELETE, INSERT, NAMES, NEXT, Blocks, before, pick

BATCH = 10_000  # rows of an output batch
HELD = 8 << 20  # bytes of texts of an output batch, about
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\f\r"


def damaged(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, text) with known faults, by the CRC-32 of ``conversation:turn``.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats
    it and 4 makes it a user's.  Nulls count as one space, in the key too; ids stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    given = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(h == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"),
        F.when(h == 3, 2).otherwise(1).alias("copies"), h.alias("h"))
    kept = given.filter("h <> 0")
    return kept.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


_ORDER = ["_conv", "_has", "_turn", "_role", "_digest"]
_DECIDED = "_conv long, _has boolean, _turn long, _role string, _digest string, _symbol int, _end int, _after string"


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Every turn with what orders it and its symbol (null if blank)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(
        F.col(conv_col).cast("long").alias("_conv"), F.col(turn_col).cast("long").alias("_turn"),
        space(role_col).alias("_role"), space(text_col).alias("_text"))
    stripped = F.rtrim(F.col("_text"), F.lit(SPACE))
    initial = F.left("_role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6)
    symbol = F.when(stripped != "", role + (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).cast("int"))
    return given.select(
        "_conv", F.col("_turn").isNotNull().alias("_has"), "_turn", "_role", F.sha2("_text", 256).alias("_digest"),
        symbol.alias("_symbol"), "_text")


def _decisions(tables: Blocks):
    """Backward over the turns that may stay: the vector behind a turn's block, and the symbols of
    the block's turns behind it, from the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no conversation yet
        vector, block = 0, []
        for batch in batches:
            ends, afters = [], []
            for conv, symbol in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if conv != current:
                    current, vector, block = conv, 0, []
                ends.append(vector)
                afters.append("".join(map(str, block)))
                block.append(symbol)
                if len(block) == tables.size:
                    vector, block = tables.ahead(vector, block), []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends, pa.int32()), pa.array(afters, pa.string())],
                [*batch.schema.names, "_end", "_after"])

    return run


class _Conversation:
    """One conversation's turns in order; ``turn(edit, role, text)`` gets those that the repair has."""

    def __init__(self, conv: int | None, tables: Blocks, turn: Callable[[str, str, str], None]):
        self.conv, self.tables, self.turn = conv, tables, turn
        self.state = self.cost = 0
        self.audit: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.distinct = 0
        self.initial: str | None = None
        self.decision: tuple | None = None

    def decide(self, symbol: int, end: int, after: str) -> None:
        self.decision = symbol, end, after

    def read(self, turn: int | None, role: str, text: str, symbol: int | None) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if symbol is None or self.decision is None:
            self.blank += symbol is None
            self.duplicate += symbol is not None
            self._done("D", DELETE)
            return
        (symbol, end, after), self.decision = self.decision, None
        self.truncated += symbol & 1
        behind = self.tables.vectors[self.tables.inside(end, after)]
        here = before(behind, symbol)
        edit = "I"
        while edit == "I":
            edit, onward, cost = pick(self.state, symbol, here, behind)
            if edit == "I":
                self.turn(edit, NAMES[onward], "")
            elif edit != "D":
                self.turn(edit, role if edit == "K" else NAMES[onward], text)
            self.state = onward
            self._done(edit, cost)

    def _done(self, edit: str, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost

    def finish(self) -> None:
        while self.tables.vectors[0][self.state]:
            self.state = NEXT[self.state]
            self.turn("I", NAMES[self.state], "")
            self._done("I", INSERT)

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


_REPORT = pa.schema([
    ("_conv", pa.int64()), *((name, pa.int64()) for name in ("_gaps", "_blank", "_duplicate", "_truncated", "_illegal", "_cost")),
    ("_audit", pa.string()), ("_sha", pa.string())])
_TURNS = pa.schema([("_conv", pa.int64()), ("_place", pa.int64()), ("_role", pa.string()), ("_text", pa.string()), ("_edit", pa.string())])


def _repaired(tables: Blocks, reports: bool):
    """Forward over all turns and decisions, sorted; reports of conversations, or their turns."""
    schema = _REPORT if reports else _TURNS

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        current: _Conversation | None = None
        digest = hashlib.sha256()
        place = 0

        def turn(edit: str, role: str, text: str) -> None:
            nonlocal place, held
            if reports:
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            else:
                out.append((current.conv, place, role, text, edit))
                held += len(text)
            place += 1

        def report() -> None:
            current.finish()
            if reports:
                out.append((current.conv, current.gaps, current.blank, current.duplicate, current.truncated,
                            current.illegal, current.cost, "".join(current.audit), digest.hexdigest()))

        for whole in batches:
            for part in slices(whole, 6):
                columns = (column.to_pylist() for column in part.columns)
                for conv, _, number, role, _, symbol, text, kind, end, after in zip(*columns, strict=True):
                    if current is None or conv != current.conv:
                        if current is not None:
                            report()
                        current, digest, place = _Conversation(conv, tables, turn), hashlib.sha256(), 0
                    if kind == 0:
                        current.decide(symbol, end, after)
                    elif kind == 1:
                        current.read(number, role, text, symbol)
                    if len(out) >= BATCH or held > HELD:
                        yield batch(out)
                        out, held = [], 0
        if current is not None:
            report()
        yield batch(out)

    return run


def _sorted_turns(
    rows: DataFrame, every: DataFrame, tables: Blocks, conv_col: str, turn_col: str, role_col: str, text_col: str,
) -> DataFrame:
    """All turns of a conversation in one partition and in order, each after its decision."""
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    light = turns.filter("_symbol is not null").groupBy("_conv", "_role", "_digest").agg(
        F.min(F.struct("_has", "_turn")).alias("_at"), F.min("_symbol").alias("_symbol")
    ).select("_conv", "_at._has", "_at._turn", "_role", "_digest", "_symbol")
    backward = [F.col(c).desc() for c in _ORDER]
    decided = light.repartition("_conv").sortWithinPartitions(*backward).mapInArrow(_decisions(tables), _DECIDED)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    columns = [*_ORDER, "_symbol", "_text", "_kind", "_end", "_after"]
    texts = turns.select("*", F.lit(1).alias("_kind"), none("int", "_end"), none("string", "_after"))
    told = decided.select("*", none("string", "_text"), F.lit(0).alias("_kind"))
    named = every.select(
        F.col(conv_col).cast("long").alias("_conv"), F.lit(False).alias("_has"), none("long", "_turn"), none("string", "_role"),
        none("string", "_digest"), none("int", "_symbol"), none("string", "_text"), F.lit(2).alias("_kind"), none("int", "_end"),
        none("string", "_after")).groupBy(*columns).agg(F.lit(1)).select(columns)
    union = texts.select(columns).unionByName(told.select(columns)).unionByName(named)
    return union.repartition("_conv").sortWithinPartitions(*_ORDER, "_kind")


def repair(
    rows: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(_conv, _gaps, _blank, _duplicate, _truncated, _illegal, _cost, _audit, _sha) per conversation.

    ``_audit`` has the initials of the cheapest edits (Keep, Rerole, Delete, Insert; of equal ones the
    ASCII-least), ``_sha`` the SHA-256 of the repaired ``role:text`` lines.  ``every`` may name
    conversations without rows: zeros, an empty audit and the digest of nothing.

    Turns are ordered by number, nulls first, then by role and by the SHA-256 of the text, all in code-point
    order.  A null role or text is one space; rows without a conversation are one conversation;
    conversation and turn are cast to long; repeated rows are duplicates; roles with other
    initials than s, u and a are never kept; other columns are not looked at; an empty table
    gives an empty table.
    """
    tables = Blocks()
    names = conv_col, turn_col, role_col, text_col
    streamed = _sorted_turns(rows, rows if every is None else every, tables, *names)
    kinds = {"int64": "long", "string": "string"}
    return streamed.mapInArrow(_repaired(tables, True), ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in _REPORT))


def repaired_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(_conv, _place, _role, _text, _edit): the turns of the repaired conversations, places from 0.

    Faults, order and odd rows are as of ``repair``; conversations of which nothing is left have no rows.
    """
    tables = Blocks()
    streamed = _sorted_turns(rows, rows, tables, conv_col, turn_col, role_col, text_col)
    return streamed.mapInArrow(_repaired(tables, False), "_conv long, _place long, _role string, _text string, _edit string")
