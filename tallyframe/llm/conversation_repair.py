"""Repair of conversation structure at least cost (operator 12): a cost DP, and prefix-doubling ranks of its optimal arcs.

A conversation's rows are kept, given another role, or deleted, and empty rows are inserted, so that
the roles read ``(s?(ua)+)?``: nothing, or an optional system row and then user and assistant in turn. The audit
is the string of the edits' initials; of the cheapest edits those of the least audit (by ASCII) are chosen.

A node is a place between two rows with a state (nothing yet, after system, after user, after
assistant); an arc is an edit and its initial. The arcs out of a node have different initials.

* The cost DP runs backward, as products of 4 x 4 (min, +) matrices: each piece of a conversation gives its
  matrix, the pieces of a conversation are passed once from the last to the first, and then every piece knows
  the cost to go at its end, with which its own nodes' costs and optimal arcs follow.
* The optimal arcs' nodes are ranked by the first 1, 2, 4, ... letters of the least audit that
  follows: a node's rank by 2n letters is that of the pair of its rank by n letters and the rank of the
  node n letters on, which a doubled pointer holds. At each node the ranks choose the least path, whose nodes
  are read off the same pointers by the binary digits of their distance.
* One pass over the pieces from the first to the last then gives the state each one is entered in.

Rows are stored in range order once. A block is a stretch of consecutive stored rows, of one or many
conversations, and a piece is what a block holds of one; so a conversation of any size is worked on by many tasks,
and a task holds one block. Passes over pieces and over repaired rows are streams of sorted rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import prepare, written
from .ordering import ROW, in_order

#: Rows of a block, as a power of two.
BLOCK_ROWS_LOG2 = 12

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "DIKR"  # in order of their ASCII codes
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: KEEPS[state][initial of the row's role: another one, s, u, a] is the state after keeping the row, or -1.
KEEPS = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
#: Cost and audit of the rows that have to follow the last row.
ENDS = (0, 6, 3, 0)
TAILS = ("", "II", "I", "")
FAR = np.int64(1) << 60
#: Nodes of paths that are read off at once.
PATH_CELLS = 1 << 18
INITIALS = {"s": 1, "u": 2, "a": 3}
LEGAL = {"su", "ua", "au"}
ROLES = {USER: "user", ASSISTANT: "assistant"}

WHITE = r"\x20\x09-\x0D"
PIECE = "conv long, block long, costs array<long>, illegal long, first string, last string"
ENTERED = "conv long, block long, first_row long, audit string"


class Pieces:
    """The pieces of one block: rows (initial, forced, truncated) by ``start`` (n + 1)."""

    def __init__(self, initial: np.ndarray, forced: np.ndarray, truncated: np.ndarray, start: np.ndarray):
        self.initial, self.forced, self.start = initial, forced, start
        self.late = np.where(truncated, TRUNCATED, 0).astype(np.int64)
        self.size = np.diff(start)

    def costs(self, ends: np.ndarray) -> np.ndarray:
        """Least cost from each node (row place + its piece's number, state) to its piece's end, for ``ends`` (piece, 4, m) at the ends."""
        n, m = len(self.size), ends.shape[2]
        out = np.empty((int(self.start[-1]) + n, 4, m), np.int64)
        at = self.start[1:] + np.arange(n)
        out[at] = ends
        value, alive = ends.copy(), np.arange(n)
        for back in range(1, int(self.size.max(initial=0)) + 1):
            alive = alive[self.size[alive] >= back]
            row = self.start[alive + 1] - back
            v, late, stays = value[alive], self.late[row][:, None], self.forced[row][:, None]
            new = v + DELETE
            for x in range(4):
                to = KEEPS[x][self.initial[row]]
                kept = np.where((to >= 0)[:, None] & ~stays, v[np.arange(len(row)), to] + KEEP + late, FAR)
                changed = np.where(stays, FAR, v[:, NEXT[x]] + REROLE + late)
                new[:, x] = np.minimum(new[:, x], np.minimum(kept, changed))
            for _ in range(3):  # rows inserted before this one; more than two never pay
                new = np.minimum(new, new[:, NEXT] + INSERT)
            value[alive] = new
            out[at[alive] - back] = new
        return out

    def least_paths(self, ends: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
        """Exit state and least audit of each piece for each entry state, by prefix-doubling ranks."""
        n = len(self.size)
        cost = np.minimum(self.costs(ends[:, :, None])[:, :, 0], FAR)
        places = len(cost)
        node = np.arange(4 * places).reshape(places, 4)
        row_of = np.arange(places) - np.repeat(np.arange(n), self.size + 1)
        last = np.zeros(places, bool)
        last[self.start[1:] + np.arange(n)] = True
        row = np.where(last, 0, row_of)
        arcs = np.full((places, 4, 4), -1, np.int64)  # target by letter, of optimal arcs only
        if len(self.initial):
            late, stays, initial = self.late[row], self.forced[row] | last, self.initial[row]
            onward = np.minimum(np.arange(places) + 1, places - 1)
            for x in range(4):
                arcs[:, x, 0] = np.where(~last & (cost[:, x] == cost[onward, x] + DELETE), node[onward, x], -1)
                arcs[:, x, 1] = np.where(~last & (cost[:, x] == cost[:, NEXT[x]] + INSERT), node[:, NEXT[x]], -1)
                to = KEEPS[x][initial]
                arcs[:, x, 2] = np.where(~stays & (to >= 0) & (cost[:, x] == cost[onward, to] + KEEP + late), node[onward, to], -1)
                arcs[:, x, 3] = np.where(~stays & (cost[:, x] == cost[onward, NEXT[x]] + REROLE + late), node[onward, NEXT[x]], -1)
        arcs = arcs.reshape(-1, 4)
        there = arcs >= 0
        # the first letter, and the node after it; an end of a piece stays where it is and ranks first
        letter = np.where(there.any(1), there.argmax(1) + 1, 0)
        jump = np.where(letter > 0, arcs[np.arange(len(arcs)), letter - 1], np.arange(len(arcs)))
        rank, pointers, length = letter.astype(np.int64), [jump], 1
        entries = node[self.start[:-1] + np.arange(n)].ravel()
        while (letter[jump] > 0).any():
            rank = np.unique(rank * (len(arcs) + 1) + rank[jump], return_inverse=True)[1].ravel()
            jump, length = jump[jump], 2 * length
            pointers.append(jump)
        # of a node's optimal arcs the one of least letter, then of least rank behind it
        choice = np.where(there, np.arange(4) * (len(arcs) + 1) + rank[np.maximum(arcs, 0)], FAR).argmin(1)
        exits, step, text = pointers[-1][entries], np.arange(length), np.array(list(LETTERS))
        audits: list[str] = []
        width = max(1, PATH_CELLS // length)
        for some in range(0, len(entries), width):
            at = np.repeat(entries[some: some + width, None], length, 1)
            for k, p in enumerate(pointers[:-1]):
                at = np.where(step >> k & 1, p[at], at)
            audits.extend("".join(text[choice[x[letter[x] > 0]]]) for x in at)
        return (exits % 4).reshape(n, 4), [audits[4 * i: 4 * i + 4] for i in range(n)]


def damaged(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with the damage of the contract, drawn by crc32 of conversation and turn: dropped, emptied, unpunctuated, repeated, made the user's."""
    drawn = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (key, turn))).cast("binary")) % 20
    rows = conversations.select(F.col(key), F.col(turn), F.coalesce(F.col(role), F.lit(" ")).alias(role), F.coalesce(F.col(text), F.lit(" ")).alias(text), drawn.alias("__drawn"))
    rows = rows.filter("__drawn <> 0")
    body = F.when(F.col("__drawn") == 1, "").when(F.col("__drawn") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text))
    copies = F.explode(F.when(F.col("__drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(key, turn, F.when(F.col("__drawn") == 4, "user").otherwise(F.col(role)).alias(role), body.alias(text), copies.alias("__copy")).drop("__copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Stored rows with their block and their first fault. The first of equal rows is found by an aggregate, so a text that a conversation repeats without end is no group."""
    seen = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    cut = ~F.col("text").rlike(f"(?s)[.!?][{WHITE}]*\\z")
    narrow = rows.select("conv", ROW, "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), seen.alias("seen"))
    again = narrow.groupBy("conv", "seen").agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("c"), F.col("seen").alias("s"), "first")
    joined = narrow.join(again, narrow["conv"].eqNullSafe(again["c"]) & (narrow["seen"] == again["s"]), "left")
    duplicate = F.coalesce(F.col(ROW) > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(duplicate, "duplicate").when(F.col("cut"), "truncated")
    return joined.select("conv", ROW, "turn", "initial", fault.alias("fault"), F.shiftright(ROW, BLOCK_ROWS_LOG2).alias("block"))


def _pieces(table: pa.Table) -> tuple[pa.Table, Pieces, list]:
    table = table.sort_by(ROW)
    conv = table.column("conv").to_pylist()
    start = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
    fault = np.array(table.column("fault").to_pylist(), object)
    initial = np.array([INITIALS.get(x, 0) for x in table.column("initial").to_pylist()], np.int64)
    pieces = Pieces(initial, (fault == "blank") | (fault == "duplicate"), fault == "truncated", np.array([*start, len(conv)]))
    return table, pieces, [conv[i] for i in start]


def _matrices(rows: DataFrame) -> DataFrame:
    unit = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        table, pieces, conv = _pieces(table)
        n = len(conv)
        cost = pieces.costs(np.repeat(unit[None], n, 0))[pieces.start[:-1] + np.arange(n)]
        initial = table.column("initial").to_pylist()
        spans = list(zip(pieces.start[:-1].tolist(), pieces.start[1:].tolist(), strict=True))
        illegal = [sum(initial[i] + initial[i + 1] not in LEGAL for i in range(a, b - 1)) for a, b in spans]
        return pa.table({"conv": pa.array(conv, pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * n, pa.int64()),
                         "costs": pa.array(np.minimum(cost, FAR).reshape(n, 16).tolist(), pa.list_(pa.int64())), "illegal": pa.array(illegal, pa.int64()),
                         "first": pa.array([initial[a] for a, _ in spans], pa.string()), "last": pa.array([initial[b - 1] for _, b in spans], pa.string())})

    return rows.groupBy("block").applyInArrow(run, PIECE)


def _streamed(rows: DataFrame, order: list, run, schema: str) -> DataFrame:
    """``run`` over the rows of each conversation in order, a batch at a time: a conversation's rows follow one another in one task."""
    return rows.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, schema)


def _costs_to_go(pieces: DataFrame) -> DataFrame:
    """The pieces with the least cost from each state at their end to the conversation's end, and from their start when nothing is there yet; last piece first."""

    def run(batches):
        conv, ends = object(), None
        for batch in batches:
            out, cost = [], []
            for c, costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                if c != conv or ends is None:
                    conv, ends = c, list(ENDS)
                out.append(ends)
                ends = [min(costs[4 * x + y] + ends[y] for y in range(4)) for x in range(4)]
                cost.append(ends[START])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(out, pa.list_(pa.int64())), pa.array(cost, pa.int64())], ["conv", "block", "ends", "cost"])

    return _streamed(pieces.select("conv", "block", "costs"), [F.desc("block")], run, "conv long, block long, ends array<long>, cost long")


def _paths(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """For each piece and entry state the exit state and the least audit."""

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        table, pieces, conv = _pieces(table)
        by = dict(zip(given.column("conv").to_pylist(), given.column("ends").to_pylist(), strict=True))
        exits, audits = pieces.least_paths(np.array([by[c] for c in conv], np.int64))
        row = table.column(ROW).to_numpy()[pieces.start[:-1]]
        return pa.table({"conv": pa.array(conv, pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * len(conv), pa.int64()), "first_row": pa.array(row, pa.int64()),
                         "exits": pa.array(exits.tolist(), pa.list_(pa.int32())), "audits": pa.array(audits, pa.list_(pa.string()))})

    return (rows.groupBy("block").cogroup(ends.groupBy("block"))
            .applyInArrow(run, "conv long, block long, first_row long, exits array<int>, audits array<string>"))


def _entered(paths: DataFrame) -> DataFrame:
    """The pieces with their part of the conversation's audit, that of the state they are entered in; first piece first."""

    def run(batches):
        conv, state = object(), None
        for batch in batches:
            audit = []
            for c, exits, audits in zip(*(batch.column(x).to_pylist() for x in ("conv", "exits", "audits")), strict=True):
                if c != conv or state is None:
                    conv, state = c, START
                audit.append(audits[state])
                state = exits[state]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), batch.column("first_row"), pa.array(audit, pa.string())], ["conv", "block", "first_row", "audit"])

    return _streamed(paths, ["block"], run, ENTERED)


class Editor:
    """Applies the audit of one conversation to its rows as they come: (role, text, edit) of the repaired rows, in order."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.at, self.rows, self.audits = conv, START, "", 0, 0, []

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at, self.rows = int(NEXT[self.state]), self.at + 1, self.rows + 1
            yield ROLES[self.state], "", "I"

    def piece(self, audit: str):
        """The next piece begins; all rows of the last one have been given."""
        yield from self._inserted()
        self.audit, self.at = audit, 0
        self.audits.append(audit)

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self.state = int(KEEPS[self.state][INITIALS[role[0]]] if edit == "K" else NEXT[self.state])
            self.rows += 1
            yield role if edit == "K" else ROLES[self.state], text, edit

    def end(self):
        """What follows the last row."""
        yield from self._inserted()
        yield from self.piece(TAILS[self.state])
        yield from self._inserted()


REPAIRED = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
DIGESTS = pa.schema([("conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class Repair:
    """The least repair of each conversation of ``df``: rows by turn (nulls first), then role and text; nulls of role and text are one space.

    Rows without a conversation id are one conversation. Of equal rows all but the first are duplicates. The initial of a role is
    its first character; an empty role has none and fits nowhere. An empty table has no conversations. Other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        spark = df.sparkSession
        prepare(spark)
        rows = df.select(F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
        self.rows = in_order(spark, rows, ["conv", "turn", "role", "text"], "turns")
        self.faults = written(spark, _faults(self.rows), "faults")
        narrow = self.faults.select("conv", ROW, "initial", "fault", "block")
        self.pieces = written(spark, _matrices(narrow), "pieces")
        self.ends = written(spark, _costs_to_go(self.pieces), "ends")
        self.audits = written(spark, _entered(_paths(narrow, self.ends.drop("cost"))), "audits")

    def _edited(self, begin, give, end, schema: pa.Schema) -> DataFrame:
        """Applies the audits to the rows as they stream by: ``begin()`` per conversation makes what ``give`` gets with its edited rows, and ``end`` at last."""
        events = (self.rows.select("conv", F.col(ROW).alias("at"), F.lit(1).alias("what"), "role", "text")
                  .unionByName(self.audits.select("conv", F.col("first_row").alias("at"), F.lit(0).alias("what"), F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"))))

        def run(batches):
            editor = held = None
            for batch in batches:
                out: list[dict] = []
                for conv, what, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "what", "role", "text")), strict=True):
                    if editor is None or editor.conv != conv:
                        if editor is not None:
                            out.extend(give(editor, held, editor.end()))
                            out.extend(end(editor, held))
                        editor, held = Editor(conv), begin()
                    out.extend(give(editor, held, editor.row(role, text) if what else editor.piece(role)))
                yield pa.RecordBatch.from_pylist(out, schema)
            if editor is not None:
                out = list(give(editor, held, editor.end()))
                yield pa.RecordBatch.from_pylist([*out, *end(editor, held)], schema)

        return _streamed(events, ["at", "what"], run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema))

    def repaired(self) -> DataFrame:
        """(conv, place, role, text, edit): the rows of the repaired conversations; one that loses all its rows has none."""

        def give(editor, count, rows):
            for role, text, edit in rows:
                yield {"conv": editor.conv, "place": next(count), "role": role, "text": text, "edit": edit}

        return self._edited(itertools.count, give, lambda editor, count: (), REPAIRED)

    def digests(self) -> DataFrame:
        """(conv, audit, repaired_sha256): the digest of the repaired ``role:text`` rows, joined by newlines."""

        def give(editor, state, rows):
            for role, text, _ in rows:
                state.update(f"{chr(10) if editor.rows > 1 else ''}{role}:{text}".encode())
            return ()

        return self._edited(hashlib.sha256, give, lambda editor, state: [{"conv": editor.conv, "audit": "".join(editor.audits), "repaired_sha256": state.hexdigest()}], DIGESTS)

    def report(self) -> DataFrame:
        """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        kinds = ("blank", "duplicate", "truncated")
        turns = self.faults.groupBy("conv", "turn").agg(*(F.count_if(F.col("fault") == k).alias(k) for k in kinds))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        counted = turns.groupBy("conv").agg(gaps, *(F.sum(k).alias(k) for k in kinds))

        def across(batches):
            conv, before = object(), None
            for batch in batches:
                out = []
                for c, first, last in zip(*(batch.column(x).to_pylist() for x in ("conv", "first", "last")), strict=True):
                    out.append(int(c == conv and before + first not in LEGAL))
                    conv, before = c, last
                yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out, pa.int64())], ["conv", "illegal"])

        edges = _streamed(self.pieces.select("conv", "block", "first", "last"), ["block"], across, "conv long, illegal long")
        illegal = self.pieces.select("conv", "illegal").unionByName(edges).groupBy("conv").agg(F.sum("illegal").alias("illegal"))
        cost = self.ends.groupBy("conv").agg(F.min_by("cost", "block").alias("cost"))
        parts = counted
        for more in (illegal, cost, self.digests()):
            parts = parts.unionByName(more, allowMissingColumns=True)
        return parts.groupBy("conv").agg(*(F.max(c).alias(c) for c in ("gaps", *kinds, "illegal", "cost", "audit", "repaired_sha256")))


def repair_report(conversations: DataFrame, rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """The report on ``rows`` (see ``Repair``) for every id of ``conversations``; one without rows has zeros, an empty audit and the digest of the empty text."""
    report = Repair(rows, key).report().unionByName(conversations.select(F.col(key).cast("long").alias("conv")).distinct(), allowMissingColumns=True)
    zeros, empty = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), hashlib.sha256(b"").hexdigest()
    return report.groupBy(F.col("conv").alias(key)).agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in zeros),
                                                        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
