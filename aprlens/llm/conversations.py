"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Rows are dealt by conversation and sorted by turn, and Arrow batches are read as a stream. What a repair needs of the rest
of a conversation is one cost per state of the role grammar, so the first stream goes from the last turn to the first: it
carries these four costs across batches and keeps, per row, a two-byte number of the step that was taken (the backpointer).
Costs up to a constant take few values, so a step is one look-up in a table that fills itself. Backpointers of giant
conversations are spilled to the shared folder in blocks. At the first turn they are followed forward and give the audit.
The second stream goes forward over the texts, beside their conversation's audit, and gives the repaired rows. No stream
ever holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .files import delete_file, read_file, write_file
from .shared import scratch

# The cost of each edit and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

BLANKS = r"\x20\x09-\x0D"
SPILL_ROWS = 1 << 23
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
AUDIT_SCHEMA = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"
REPAIRED_SCHEMA = "conv_id long, position long, edit string, role string, text string"
DIGEST_SCHEMA = f"{AUDIT_SCHEMA}, repaired_sha256 string"

_SOUND, _TRUNCATED, _DUPLICATE, _BLANK = range(4)
_OTHER = 3
# States of the grammar: nothing yet, after s, after u, after a. Reading from one, the initial (by its place in "sua") that
# may be kept leads on; a rerole or an insert is possible with the one role that fits.
_NEXT = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
_FITTING = [2, 2, 3, 2]
_ENDS = (0, 3)
_ROLE_AFTER = {2: "user", 3: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_INFINITE = float("inf")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space.

    0 drops the row, 1 empties its text, 2 takes the sentence ends out of it, 3 repeats the row, 4 makes its role user.
    """
    value = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn"))) % 20
    rows = conversations.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), fault.alias("_fault"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where("_fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("_copies")).drop("col")


def _prepared(turns: DataFrame) -> DataFrame:
    """The four columns, nulls as one space, and ``digest`` of role and text, which orders the rows of one turn."""
    value = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), value("role"), value("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.sha2(whole, 256)))


def _turn_key(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def _thin_rows(turns: DataFrame) -> DataFrame:
    """Rows without their texts: ``kind`` (fault and initial of the role) and ``n`` equal rows of one turn.

    Which rows repeat an earlier one is found by an aggregate over (conversation, role and text), which tasks reduce
    before the shuffle; only texts that occur again take part in the join.
    """
    text = F.col("text")
    fault = (
        F.when(~text.rlike(f"[^{BLANKS}]"), _BLANK)
        .when(text.rlike(rf"[.!?][{BLANKS}]*\z"), _SOUND)
        .otherwise(_TRUNCATED)
    )
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(_OTHER)
    seen = turns.select("conv_id", "turn", "role", "digest", (fault * 4 + initial).cast("int").alias("kind"))
    rows = seen.groupBy("conv_id", "turn", "role", "digest", "kind").agg(F.count(F.lit(1)).alias("n"))
    repeated = (
        rows.where(F.col("kind") < _BLANK * 4)
        .groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"))
        .agg(F.min(_turn_key(F.col("turn"))).alias("_first"), F.count(F.lit(1)).alias("_turns"))
        .where("_turns > 1")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    again = F.coalesce(F.col("_first") < _turn_key(F.col("turn")), F.lit(False))
    kind = F.when(again, _DUPLICATE * 4 + F.col("kind") % 4).otherwise(F.col("kind")).cast("int")
    return rows.join(repeated, same, "left").select("conv_id", "turn", "role", "digest", kind.alias("kind"), "n")


class Steps:
    """The table of steps: from the costs behind a row and its kind to the costs before it and the edits chosen.

    Costs are relative to their least; a step's number is what a backpointer holds.
    """

    def __init__(self) -> None:
        self.by_costs: dict[tuple, tuple] = {}
        self.edits: list[tuple[str, tuple]] = []  # by number: letters of the four states, and the states they lead to
        self.numbers: dict[tuple, int] = {}
        self.end, _, self.stop = self._settled([(0, "", s) if s in _ENDS else (_INFINITE, "", s) for s in range(4)])

    def _settled(self, best: list[tuple]) -> tuple[tuple, float, int]:
        """Costs with inserts allowed; equal costs go to the least letter. No two edits of a state share a letter."""
        costs = [c for c, _, _ in best]
        for _ in range(3):
            costs = [min(c, INSERT + costs[_FITTING[s]]) for s, c in enumerate(costs)]
        chosen = [
            min((c, letter, to), (INSERT + costs[_FITTING[s]], "I", _FITTING[s])) for s, (c, letter, to) in enumerate(best)
        ]
        edits = ("".join(x[1] or "." for x in chosen), tuple(x[2] for x in chosen))
        number = self.numbers.setdefault(edits, len(self.edits))
        if number == len(self.edits):
            self.edits.append(edits)
        low = min(costs)
        return tuple(c - low for c in costs), low, number

    def before(self, costs: tuple, kind: int) -> tuple[tuple, float, int]:
        found = self.by_costs.get((costs, kind))
        if found is None:
            fault, initial = divmod(kind, 4)
            stay = TRUNCATED if fault == _TRUNCATED else 0
            best = []
            for s in range(4):
                options = [(DELETE + costs[s], "D", s)]
                if fault in (_SOUND, _TRUNCATED):
                    options.append((REROLE + stay + costs[_FITTING[s]], "R", _FITTING[s]))
                    if initial in _NEXT[s]:
                        to = _NEXT[s][initial]
                        options.append((KEEP + stay + costs[to], "K", to))
                best.append(min(options))
            found = self.by_costs[costs, kind] = self._settled(best)
        return found


class _Conversation:
    """One conversation, read from its last row to its first."""

    def __init__(self, steps: Steps, folder: str, spill_rows: int):
        self.steps, self.folder, self.spill_rows = steps, folder, spill_rows
        self.costs, self.cost = steps.end, 0
        self.back, self.blocks = array("H"), []
        self.faults = [0] * 4
        self.illegal = self.distinct = 0
        self.later = self.low = self.high = None

    def add(self, turn: int | None, kind: int, n: int) -> None:
        fault, initial = divmod(kind, 4)
        if self.later is not None and (initial, self.later) not in _LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # no role may follow itself
        self.later = initial
        if turn is not None and turn != self.low:
            self.distinct += 1
            self.low = turn
            self.high = turn if self.high is None else self.high
        if fault == _BLANK:
            self._deleted(kind, n)
        elif n > 1:  # all but the first repeat it
            self._deleted(_DUPLICATE * 4 + initial, n - 1)
        if fault != _BLANK:
            self.faults[fault] += 1
            self._step(kind)

    def _deleted(self, kind: int, n: int) -> None:
        """Rows that have to go, each at the same price: after one step the costs stay as they are."""
        self.faults[kind // 4] += n
        self._step(kind)
        self.cost += DELETE * (n - 1)
        number = self.back[-1]
        while n > 1:
            room = min(n - 1, self.spill_rows)
            self.back.extend(array("H", [number]) * room)
            n -= room
            self._spill()

    def _step(self, kind: int) -> None:
        self.costs, more, number = self.steps.before(self.costs, kind)
        self.cost += more
        self.back.append(number)
        if len(self.back) >= 2 * self.spill_rows:
            self._spill()

    def _spill(self) -> None:
        """Writes full blocks; the newest backpointers, which are read first, stay."""
        while len(self.back) >= 2 * self.spill_rows:
            block, self.back = self.back[: self.spill_rows], self.back[self.spill_rows :]
            self.blocks.append(write_file(self.folder, f"back-{uuid.uuid4().hex}", block.tobytes()))

    def audit(self) -> str:
        letters, state = [], 0
        edits = self.steps.edits

        def follow(number: int, state: int) -> int:
            letter, to = edits[number]
            while letter[state] == "I":
                letters.append("I")
                state = to[state]
            if letter[state] != ".":
                letters.append(letter[state])
                state = to[state]
            return state

        done: list[str] = []
        for block in (None, *reversed(self.blocks)):
            back = self.back if block is None else array("H", read_file(self.folder, block))
            for number in reversed(back):
                state = follow(number, state)
            done.append("".join(letters))
            letters.clear()
            if block is not None:
                delete_file(self.folder, block)
        follow(self.steps.stop, state)
        return "".join([*done, *letters])

    def row(self, conv_id: int | None) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        faults = self.faults
        cost = int(self.cost + self.costs[0])
        return conv_id, gaps, faults[_BLANK], faults[_DUPLICATE], faults[_TRUNCATED], self.illegal, cost, self.audit()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _audit_batches(folder: str, spill_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = _arrow_schema(AUDIT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, out, size = Steps(), [], 0
        current, open_one = None, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "kind", "n")]
            for conv_id, turn, kind, n in zip(*columns, strict=True):
                if open_one is None or conv_id != current:
                    if open_one is not None:
                        out.append(open_one.row(current))
                        size += 100 + len(out[-1][-1])
                        if size > 1 << 22:
                            yield _batch(out, schema)
                            out, size = [], 0
                    current, open_one = conv_id, _Conversation(steps, folder, spill_rows)
                open_one.add(turn, kind, n)
        if open_one is not None:
            out.append(open_one.row(current))
        if out:
            yield _batch(out, schema)

    return run


def _streamed(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def audits(turns: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """Counts, cost and ``audit`` of every conversation in ``turns`` (``conv_id, turn, role, text``, one row a turn).

    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (its last sign ends no
    sentence). ``audit`` holds the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert), the least in
    ASCII of equally cheap ones. Null roles and texts count as one space, a null conversation is one of its own, null
    turns come first, and rows of one turn go by role, then by the hash of role and text.
    """
    return _audits(_prepared(turns), spill_rows)


def _audits(turns: DataFrame, spill_rows: int) -> DataFrame:
    rows = _thin_rows(turns)
    backwards = (F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc())
    rows = _streamed(rows, *backwards).select("conv_id", "turn", "kind", "n")
    return rows.mapInArrow(_audit_batches(scratch(turns.sparkSession, "backpointers"), spill_rows), AUDIT_SCHEMA)


class _Mended:
    """Follows an audit forward over a conversation's rows."""

    def __init__(self, head: tuple):
        self.head, self.audit, self.at, self.position, self.state = head, head[-1], 0, 0, 0

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _FITTING[self.state]
            yield self._row("I", _ROLE_AFTER[self.state], "")

    def rows(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _NEXT[self.state]["sua".index(role[0])]
            yield self._row("K", role, text)
        elif letter == "R":
            self.state = _FITTING[self.state]
            yield self._row("R", _ROLE_AFTER[self.state], text)

    def _row(self, edit: str, role: str, text: str) -> tuple:
        self.position += 1
        return self.head[0], self.position - 1, edit, role, text


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple | None]]:
    """(head of the conversation, repaired row) in order, and (head, None) at the end of each conversation."""
    now = None
    for batch in batches:
        for conv_id, audit, role, text, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:  # the head comes before the rows
                if now is not None:
                    yield from ((now.head, r) for r in now.inserts())
                    yield now.head, None
                now = _Mended((conv_id, *counts, audit))
            else:
                for row in now.rows(role, text):
                    yield now.head, row
    if now is not None:
        yield from ((now.head, r) for r in now.inserts())
        yield now.head, None


def _second_stream(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order."""
    none = F.lit(None)
    heads = found.select(
        "conv_id", "audit", none.cast("string").alias("role"), none.cast("string").alias("text"), *COUNTS,
        F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast("binary").alias("digest"),
    )
    rows = turns.select(
        "conv_id", none.cast("string").alias("audit"), "role", "text", *[none.cast("long").alias(c) for c in COUNTS],
        F.lit(1).alias("part"), "turn", "digest",
    )
    ordered = _streamed(heads.unionByName(rows), "part", F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("conv_id", "audit", "role", "text", *COUNTS)


def _repaired_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, schema = [], 0, _arrow_schema(REPAIRED_SCHEMA)
    for _, row in _mended(batches):
        if row is not None:
            out.append(row)
            size += 100 + len(row[-1])
            if size > 1 << 22:
                yield _batch(out, schema)
                out, size = [], 0
    if out:
        yield _batch(out, schema)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, schema = [], 0, _arrow_schema(DIGEST_SCHEMA)
    hashed = hashlib.sha256()
    for head, row in _mended(batches):
        if row is not None:
            _, position, _, role, text = row
            hashed.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            continue
        out.append((*head, hashed.hexdigest()))
        size += 300 + len(head[-1])
        hashed = hashlib.sha256()
        if size > 1 << 22:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def repaired_turns(turns: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """The repaired rows: ``conv_id``, ``position`` from 0, the ``edit`` that gave the row, ``role`` and ``text``."""
    turns = _prepared(turns)
    return _second_stream(turns, _audits(turns, spill_rows)).mapInArrow(_repaired_batches, REPAIRED_SCHEMA)


def repair_digests(turns: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """:func:`audits` with ``repaired_sha256``, over ``role:text`` of the repaired rows, joined by line breaks."""
    turns = _prepared(turns)
    return _second_stream(turns, _audits(turns, spill_rows)).mapInArrow(_digest_batches, DIGEST_SCHEMA)


def damage_repaired(conversations: DataFrame) -> DataFrame:
    """:func:`repair_digests` after :func:`damaged`, one row for every original conversation.

    Where no row is left: zeros, an empty audit, the hash of nothing. An empty table gives an empty result; other columns
    are ignored.
    """
    found = repair_digests(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    names = conversations.select(F.col("conv_id").cast("long")).distinct()
    whole = names.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    empty = dict.fromkeys(COUNTS, 0) | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return whole.fillna(empty)
