"""Conversation structure repair: the cheapest edits that make roles alternate, by lazy weighted determinisation.

A repaired conversation is empty, or an optional system turn followed by user, assistant pairs.  Edits of a row: Keep 0,
Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go); Insert of an empty user or assistant turn 5,
anywhere; a truncated row that stays adds 5.  Of the cheapest ways the one whose initials are ASCII-least is taken.

The rows of a conversation are read from the last to the first.  What the rest may cost from each of the four places
(start, after system, user, assistant) is a vector; with its smallest entry taken off it is a state of a deterministic
automaton, made when it is first met and kept in a table (state, symbol) -> (state, cost).  A scan is then one look-up
a row.  The trace goes back over the scan, from the first row on: an arc is tight where its cost and the rest's cost
are the place's own, and the least tight initial is the edit; these steps are kept in a table as well.

In Spark: rows are dealt out by ranges of (conversation, turn), so a conversation that holds a third of all rows is
spread over many tasks.  A conversation that lies inside one task and one piece of bounded size is repaired there.  Of
the others each piece is summed up as a (min, +) matrix between places; per conversation only these small rows meet,
the costs after each piece follow from the last to the first, its exits from each place by a scan, its entry from the
first to the last, and then all pieces are repaired in parallel.  Rows seen earlier in another piece are found by hash.

Defined results: null roles and texts are one space; turns are ordered by (turn nulls first, role, text); null conv_id is
a conversation; repeated rows are duplicates; a conversation without rows is empty and costs nothing; other columns
are left out; 128-bit hashes tell (conversation, role, text) apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from loomspan.llm import hashing as H
from loomspan.llm.common import materialise

_SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = " sua"  # of a row's role; 0 is any other
_STEPS = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
_INTO = (USER, USER, ASSISTANT, USER)  # the place after an inserted or reroled row
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 40
_CUT, _BLANK, _SEEN = 4, 8, 16  # beside the initial, in the byte of a row
_GOES = 8  # symbol of rows that must go
_ROWS, _CHARS = 1 << 14, 1 << 22  # of a piece


class Machine:
    """The automaton: vectors of costs as states, transitions and tight steps made on demand."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.next: list[list[tuple[int, int] | None]] = []
        self.tight: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.state((0, _FAR, _FAR, 0), closed=False)[0]

    def state(self, costs: tuple[int, ...], closed: bool = True) -> tuple[int, int]:
        """(state, what was taken off) of a vector; closed: inserts before it are counted already."""
        costs = list(costs)
        if not closed:
            for _ in range(3):
                costs = [min(c, 5 + costs[_INTO[q]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(min(c - least, _FAR) for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.next.append([None] * 9)
        return self.ids[vector], least

    @staticmethod
    def arcs(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, place after it) that consume a row, in the order of their initials."""
        yield "D", 2, q
        if symbol != _GOES:
            extra = 5 if symbol & _CUT else 0
            if (q, symbol & 3) in _STEPS:
                yield "K", extra, _STEPS[q, symbol & 3]
            yield "R", 1 + extra, _INTO[q]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.next[state][symbol]
        if found is None:
            rest = self.vectors[state]
            found = self.next[state][symbol] = self.state(tuple(min(c + rest[p] for _, c, p in self.arcs(symbol, q)) for q in range(4)), closed=False)
        return found

    def scan(self, symbols: bytes, state: int) -> tuple[list[int], int, int]:
        """From the last row to the first: the state after each row, the state before all, and the cost taken off."""
        after, cost, step = [0] * len(symbols), 0, self.step
        for i in range(len(symbols) - 1, -1, -1):
            after[i] = state
            state, c = self.next[state][symbols[i]] or step(state, symbols[i])
            cost += c
        return after, state, cost

    def edits(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """The least tight edits up to and with a row, and the place they lead to."""
        key = (after, symbol, q)
        if key not in self.tight:
            rest, said = self.vectors[after], ""
            state, off = self.step(after, symbol)
            before = [c + off for c in self.vectors[state]]
            while True:
                ways = [(e, p) for e, c, p in self.arcs(symbol, q) if c + rest[p] == before[q]]
                if before[q] == 5 + before[_INTO[q]] < _FAR and not (ways and ways[0][0] == "D"):
                    said, q = said + "I", _INTO[q]
                    continue
                self.tight[key] = said + ways[0][0], ways[0][1]
                break
        return self.tight[key]

    def trace(self, symbols: bytes, after: list[int], q: int) -> tuple[list[str], int]:
        said = []
        for symbol, state in zip(symbols, after, strict=True):
            e, q = self.tight.get((state, symbol, q)) or self.edits(state, symbol, q)
            said.append(e)
        return said, q

    @staticmethod
    def ending(q: int) -> str:
        return {SYSTEM: "II", USER: "I"}.get(q, "")


def symbols(kinds: bytes) -> bytes:
    return bytes(_GOES if k >= _BLANK else k for k in kinds)


def faults(kinds: bytes) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal."""
    blank = sum(1 for k in kinds if k & _BLANK)
    seen = sum(1 for k in kinds if k & _SEEN and not k & _BLANK)
    cut = sum(1 for k in kinds if k < _BLANK and k & _CUT)
    return blank, seen, cut, sum(not _legal(a, b) for a, b in zip(kinds, kinds[1:], strict=False))


def _legal(a: int, b: int) -> bool:
    return (a & 3, b & 3) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _turns(said: list[str], ending: str, q: int, roles: list[str], texts: list[str], kinds: bytes) -> list[dict]:
    """The repaired turns: edits of each row, from the place q on."""
    out = []
    for i, edits in enumerate([*said, ending]):
        for e in edits:
            if e == "I":
                q = _INTO[q]
                out.append({"role": _ROLE[q], "text": ""})
            elif e == "R":
                q = _INTO[q]
                out.append({"role": _ROLE[q], "text": texts[i]})
            elif e == "K":
                q = _STEPS[q, kinds[i] & 3]
                out.append({"role": roles[i], "text": texts[i]})
    return out


class _Piece:
    """Consecutive rows of a conversation; number: of the piece in its task; cut: an earlier piece of the conversation is here."""

    def __init__(self, conv, number: int, cut: bool):
        self.conv, self.number, self.cut, self.whole = conv, number, cut, False
        self.kinds, self.roles, self.texts, self.at, self.hashes = bytearray(), [], [], [], []
        self.seen: set[tuple[int, int]] = set()
        self.low = self.high = None
        self.different = self.chars = 0

    def add(self, turn, role: str, text: str, kind: int, h: tuple[int, int]) -> None:
        if turn is not None:
            if self.high is None or turn > self.high:
                self.different += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if h in self.seen:
            kind |= _SEEN
        elif not kind & _BLANK:
            self.seen.add(h)
            self.at.append(len(self.kinds))
            self.hashes.append(h)
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _flushed(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (with their size) in batches of bounded size."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size > _CHARS or len(held) >= 4096:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


_TURNS = "array<struct<role:string,text:string>>"
_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _arrow(conv: DataType, columns: str) -> tuple[str, pa.Schema]:
    """A schema that begins with conv_id, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv_id {conv.simpleString()}, {columns}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def _gaps(low, high, different: int) -> int:
    return high - low + 1 - different if different else 0


def _cut(schema: pa.Schema, rows: int, chars: int):
    """Sorted rows of a task as pieces; whole conversations leave repaired."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, machine = TaskContext.get().partitionId(), Machine()

        def row(p: _Piece) -> tuple[dict, int]:
            out = {"conv_id": p.conv, "part": part, "piece": p.number, "whole": p.whole, "kinds": bytes(p.kinds), "low": p.low, "high": p.high, "different": p.different}
            if not p.whole:
                return out | {"at": p.at, "h1": [a for a, _ in p.hashes], "h2": [b for _, b in p.hashes], "turns": [{"role": r, "text": t} for r, t in zip(p.roles, p.texts, strict=True)]}, p.chars
            kinds = bytes(p.kinds)
            after, state, cost = machine.scan(symbols(kinds), machine.end)
            said, q = machine.trace(symbols(kinds), after, START)
            counts = (_gaps(p.low, p.high, p.different), *faults(kinds), cost + machine.vectors[state][START])
            repaired = _turns(said, machine.ending(q), START, p.roles, p.texts, kinds)
            return out | dict(zip(_COUNTS, counts, strict=True)) | {"audit": "".join(said) + machine.ending(q), "turns": repaired}, p.chars

        def pieces() -> Iterator[tuple[dict, int]]:
            now, first = None, True
            for batch in batches:
                for conv, turn, role, text, live, kind, h1, h2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is None:
                        now = _Piece(conv, 0, False)  # others of the first conversation may lie in the task before
                    elif conv != now.conv:
                        now.whole = not first and not now.cut
                        yield row(now)
                        now, first = _Piece(conv, now.number + 1, False), False
                    elif len(now.kinds) >= rows or now.chars >= chars:
                        yield row(now)
                        now = _Piece(conv, now.number + 1, True)
                    if live:
                        now.add(turn, role, text, kind, (h1, h2))
            if now is not None:
                yield row(now)

        yield from _flushed(pieces(), schema)

    return of


def _summed(schema: pa.Schema):
    """Rows seen in an earlier piece are marked; each piece gets its matrix: the cost from place q to place p at 4 q + p."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        units = [machine.state(tuple(0 if q == p else _FAR for q in range(4)))[0] for p in range(4)]

        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for r in batch.to_pylist():
                    kinds = bytearray(r["kinds"])
                    for i in r.pop("late") or ():
                        kinds[i] |= _SEEN
                    columns = []
                    for unit in units:
                        _, state, cost = machine.scan(symbols(bytes(kinds)), unit)
                        columns.append([min(c + cost, _FAR) for c in machine.vectors[state]])
                    blank, seen, cut, illegal = faults(bytes(kinds))
                    yield r | {"kinds": bytes(kinds), "matrix": [columns[p][q] for q in range(4) for p in range(4)], "blank": blank, "duplicate": seen, "truncated": cut, "illegal": illegal}, 2 * len(kinds) + 200

        yield from _flushed(rows(), schema)

    return of


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool]]:
    """Rows sorted by conversation, and whether a row is its first."""
    last: list = []
    for batch in batches:
        for r in batch.to_pylist():
            yield r, last != [r["conv_id"]]
            last = [r["conv_id"]]


def _afterwards(schema: pa.Schema):
    """From the last piece of a conversation to its first: what its rest may cost after each, and from the start."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = Machine().vectors[0]

        def rows() -> Iterator[tuple[dict, int]]:
            rest = end
            for r, new in _conversations(batches):
                rest = end if new else rest
                m = r.pop("matrix")
                before = tuple(min(m[4 * q + p] + rest[p] for p in range(4)) for q in range(4))
                yield r | {"after": list(rest), "cost": before[START]}, 100
                rest = before

        yield from _flushed(rows(), schema)

    return of


def _exits(schema: pa.Schema):
    """The place where the edits of a piece lead to, from each place before it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()

        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for r in batch.to_pylist():
                    s = symbols(r["kinds"])
                    after, state, _ = machine.scan(s, machine.state(tuple(r["after"]))[0])
                    yield {k: v for k, v in r.items() if k != "kinds"} | {
                        "first": r["kinds"][0] & 3 if s else None,
                        "last": r["kinds"][-1] & 3 if s else None,
                        "exits": [machine.trace(s, after, q)[1] if machine.vectors[state][q] < _FAR else q for q in range(4)],
                    }, 200

        yield from _flushed(rows(), schema)

    return of


def _entries(schema: pa.Schema):
    """From the first piece of a conversation to its last: the place before each, its number, and the totals up to it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            held = None
            for r, new in _conversations(batches):
                if held is not None:
                    yield held | {"final": new}, 100
                if new:
                    q, number, cost, low, high, different, before = START, 0, r["cost"], None, None, 0, None
                    totals = [0, 0, 0, 0]
                totals = [a + r[k] for a, k in zip(totals, _COUNTS[1:5], strict=True)]
                if r["first"] is not None:
                    totals[3] += before is not None and not _legal(before, r["first"])
                    before = r["last"]
                if r["different"]:
                    different += r["different"] - (high == r["low"])
                    low, high = (r["low"] if low is None else low), r["high"]
                held = {"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "entry": q, "number": number, "gaps": _gaps(low, high, different), "cost": cost}
                held |= dict(zip(_COUNTS[1:5], totals, strict=True))
                q, number = r["exits"][q], number + 1
            if held is not None:
                yield held | {"final": True}, 100

        yield from _flushed(rows(), schema)

    return of


def _repaired(schema: pa.Schema):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()

        def rows() -> Iterator[tuple[dict, int]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    (r,) = batch.slice(i, 1).to_pylist()
                    kinds, turns = r.pop("kinds"), r.pop("raw")
                    after, _, _ = machine.scan(symbols(kinds), machine.state(tuple(r.pop("after")))[0])
                    entry = r.pop("entry")
                    said, q = machine.trace(symbols(kinds), after, entry)
                    ending = machine.ending(q) if r["final"] else ""
                    roles, texts = [t["role"] for t in turns], [t["text"] for t in turns]
                    made = _turns(said, ending, entry, roles, texts, kinds)
                    yield r | {"audit": "".join(said) + ending, "turns": made}, sum(len(t["text"]) for t in made)

        yield from _flushed(rows(), schema)

    return of


def damage(turns: DataFrame) -> DataFrame:
    """The rows with faults drawn from their place, and ``live``: false for a dropped row."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    drawn = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), draw.alias("_draw"))
    return drawn.select(
        "conv_id",
        "turn",
        F.when(F.col("_draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_draw") != 0).alias("live"),
        F.explode(F.expr("sequence(1, if(_draw = 3, 2, 1))")).alias("_copy"),
    ).drop("_copy")


def _kind(role: Column, text: Column) -> Column:
    """Initial, truncated and blank of a row, as one number."""
    initial = F.instr(F.lit(_INITIALS[1:]), F.substring(role, 1, 1))
    end = F.rtrim(text, F.lit(_SPACE))
    cut = F.when(~F.right(end, F.lit(1)).isin(".", "!", "?"), _CUT).otherwise(0)
    return F.when(role == "", 0).otherwise(initial) + F.when(end == "", _BLANK).otherwise(cut)


def repair(turns: DataFrame, live: str | None = None, rows: int = _ROWS, chars: int = _CHARS) -> DataFrame:
    """The repaired conversations, in pieces of bounded size.

    conv_id, number (of the piece, from 0), final (its last one), counts of faults and the cost (those of the whole
    conversation on its last piece), audit (initials of the edits), turns (role, text).  ``live`` names a boolean column:
    rows without it count only as the name of a conversation.
    """
    key = turns.schema["conv_id"].dataType
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    named = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, (F.col(live) if live else F.lit(True)).alias("live"))
    who = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    known = named.select("*", _kind(F.col("role"), F.col("text")).alias("kind"), F.xxhash64(who, "role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role", who).alias("h2"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    spark_type, arrow_type = _arrow(key, f"part int, piece int, whole boolean, kinds binary, low long, high long, different long, at array<int>, h1 array<long>, h2 array<long>, {_TOTALS}, audit string, turns {_TURNS}")
    pieces = materialise(dealt.mapInArrow(H.released(_cut(arrow_type, rows, chars)), spark_type), "pieces")
    whole = pieces.filter("whole").select("conv_id", F.lit(0).cast("long").alias("number"), F.lit(True).alias("final"), *_COUNTS, "audit", "turns")
    return whole.unionByName(materialise(_settled(pieces.filter("not whole"), key), "repaired"))


def _settled(pieces: DataFrame, key: DataType) -> DataFrame:
    """Conversations that lie in several pieces, or at the edge of a task."""
    place = ["part", "piece"]
    hashes = pieces.select(*place, F.explode(F.arrays_zip("at", "h1", "h2")).alias("x")).select(F.struct(*place).alias("place"), "x.*")
    again = hashes.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = hashes.join(again, ["h1", "h2"]).filter("place > first").groupBy("place.part", "place.piece").agg(F.collect_list("at").alias("late"))
    light = pieces.select("conv_id", *place, "kinds", "low", "high", "different").join(late, place, "left")
    counts = "blank long, duplicate long, truncated long, illegal long"
    kind, schema = _arrow(key, f"part int, piece int, kinds binary, low long, high long, different long, matrix array<long>, {counts}")
    sums = materialise(light.mapInArrow(_summed(schema), kind), "piece-sums")
    kind, schema = _arrow(key, "part int, piece int, after array<long>, cost long")
    latest = [F.col("conv_id").asc_nulls_first(), F.col("part").desc(), F.col("piece").desc()]
    rest = materialise(sums.select("conv_id", *place, "matrix").repartition("conv_id").sortWithinPartitions(*latest).mapInArrow(_afterwards(schema), kind), "piece-costs")
    known = sums.drop("matrix").join(rest.drop("conv_id"), place)
    kind, schema = _arrow(key, f"part int, piece int, low long, high long, different long, {counts}, after array<long>, cost long, first int, last int, exits array<int>")
    exits = known.mapInArrow(_exits(schema), kind).drop("after")
    kind, schema = _arrow(key, f"part int, piece int, entry int, number long, final boolean, {_TOTALS}")
    entries = exits.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *place).mapInArrow(_entries(schema), kind)
    ready = materialise(entries.join(known.select(*place, "kinds", "after"), place), "piece-entries")
    kind, schema = _arrow(key, f"number long, final boolean, {_TOTALS}, audit string, turns {_TURNS}")
    texts = pieces.select(*place, F.col("turns").alias("raw"))
    return ready.join(texts, place).drop(*place).mapInArrow(H.released(_repaired(schema)), kind)


def _streamed(schema: pa.Schema):
    """Pieces sorted by conversation and number: one row each, the hash taken as they pass."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        def rows() -> Iterator[tuple[dict, int]]:
            for r in pieces():
                if r["number"] == 0:
                    digest, audit, begun = hashlib.sha256(), [], False
                for t in r["turns"]:
                    digest.update((("\n" if begun else "") + f"{t['role']}:{t['text']}").encode())
                    begun = True
                audit.append(r["audit"])
                if r["final"]:
                    yield {k: r[k] for k in ("conv_id", *_COUNTS)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}, 200

        yield from _flushed(rows(), schema)

    return of


def report(repaired: DataFrame) -> DataFrame:
    """A row for each conversation: counts, cost, audit and the sha256 of its repaired turns.

    Pieces of one conversation pass one task in order, as a sha256 of all its turns wants; none is held.
    """
    kind, schema = _arrow(repaired.schema["conv_id"].dataType, f"{_TOTALS}, audit string, repaired_sha256 string")
    alone = (F.col("number") == 0) & F.col("final")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = repaired.filter(alone).select("conv_id", *_COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    many = repaired.filter(~alone).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "number")
    return one.unionByName(many.mapInArrow(_streamed(schema), kind))
