"""Repair of conversation structure: a generalised LR parser over the grammar of roles that may also edit.

An SLR table is derived from the grammar. Before each row the parser may insert empty user or assistant turns; then it
keeps the row, gives it another role or deletes it, so one stack becomes several. Stacks share what lies below their
tops. Stacks with equal tops are merged by the smallest (cost, audit), which loses nothing here: what may follow a log
depends on its last role alone. Rows are taken as a stream in the order of each conversation; whenever the back
pointers of all stacks meet in one place, the edits before it are final and leave, as in a streaming Viterbi search.
A step of the parser depends only on its stacks and the kind of row, of which there are few, so steps are looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Role grammar over role initials: (s?(ua)+)?
GRAMMAR = (("Log", ""), ("Log", "Body"), ("Body", "Turns"), ("Body", "s Turns"), ("Turns", "Turn"), ("Turns", "Turns Turn"),
           ("Turn", "u a"))
RULES = tuple((left, tuple(right.split())) for left, right in GRAMMAR)
NAMES = {left for left, _ in RULES}
END = "$"
#: Costs of the edits, of a truncated row that stays, and roles that edits may give.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
GIVEN = {"u": "user", "a": "assistant"}
#: A stack can follow the edits of any other at this much more at most: two insertions at an end, or an insertion and
#: the deletion of a system turn. A stack that is behind by more has lost.
BEHIND = 5
#: Inserted turns before one row: two lead from each top to each other one.
INSERTED = 2
#: Rows that may wait before it is tried whether they are final.
WAIT = 256
FAULTS = ("blank", "duplicate", "truncated")


@cache
def _items(kernel: frozenset) -> frozenset:
    """Closure of LR items (rule, place)."""
    found, open_items = set(kernel), list(kernel)
    while open_items:
        rule, place = open_items.pop()
        right = RULES[rule][1]
        if place < len(right) and right[place] in NAMES:
            fresh = {(i, 0) for i, (left, _) in enumerate(RULES) if left == right[place]} - found
            found |= fresh
            open_items += fresh
    return frozenset(found)


@cache
def _goto(state: frozenset, symbol: str) -> frozenset:
    return frozenset((rule, place + 1) for rule, place in _items(state) if RULES[rule][1][place:place + 1] == (symbol,))


@cache
def _follow(name: str) -> frozenset:
    """Terminals that may follow a name, the end of the log among them."""
    def begins(symbol: str, seen: frozenset = frozenset()) -> set:
        if symbol not in NAMES:
            return {symbol}
        return set().union(*(begins(right[0], seen | {symbol}) for left, right in RULES if left == symbol and right and right[0] not in seen | {symbol}))

    out, open_names, seen = {END} if name == "Log" else set(), [name], {name}
    while open_names:
        at = open_names.pop()
        for left, right in RULES:
            for i, symbol in enumerate(right):
                if symbol != at:
                    continue
                if i + 1 < len(right):
                    out |= begins(right[i + 1])
                elif left not in seen:
                    seen.add(left)
                    open_names.append(left)
                    out |= {END} if left == "Log" else set()
    return frozenset(out)


class Stack(NamedTuple):
    """A node of the graph of stacks: an LR state on what lies below, which other nodes may share."""

    state: frozenset
    below: Any


START = Stack(frozenset(i for i in ((rule, 0) for rule, (left, _) in enumerate(RULES) if left == "Log")), None)


@lru_cache(maxsize=4096)
def pushed(stack: Stack, terminal: str) -> Stack | None:
    """The stack after the reductions that the terminal asks for and its shift; None if it does not fit.

    For END the stack that holds a whole log.
    """
    while True:
        if terminal != END and (state := _goto(stack.state, terminal)):
            return Stack(state, stack)
        for rule, place in sorted(_items(stack.state)):
            left, right = RULES[rule]
            if place == len(right) and terminal in _follow(left):
                break
        else:
            return None
        for _ in right:
            stack = stack.below
        if left == "Log":
            return stack
        stack = Stack(_goto(stack.state, left), stack)


def top(stack: Stack) -> frozenset:
    """What stacks are merged by. A turn or body that is complete is reduced first, so that equal futures have equal tops."""
    return frozenset(t for t in "sua$" if pushed(stack, t))


#: Stacks of a parser between two rows: (stack, cost above the cheapest, rank of its audit among them). Two audits that
#: end with the same row are never prefixes of each other, so the rank decides however both go on.
Parser = tuple[tuple[Stack, int, int], ...]
FRESH: Parser = ((START, 0, 0),)


def _with_inserts(stack: Stack) -> list[tuple[Stack, tuple]]:
    out, front = [(stack, ())], [(stack, ())]
    for _ in range(INSERTED):
        front = [(after, (*edits, ("I", GIVEN[t]))) for stack, edits in front for t in GIVEN if (after := pushed(stack, t))]
        out += front
    return out


@lru_cache(maxsize=1 << 16)
def stepped(parser: Parser, initial: str, fault: str) -> tuple[Parser, int, tuple]:
    """(parser after a row, cost of its cheapest stack, for each stack (stack that it comes from, edits)).

    An edit is (initial of the edit, role); the role is None where that of the row stays.
    """
    found: dict[frozenset, tuple] = {}
    for i, (stack, cost, rank) in enumerate(parser):
        for now, edits in _with_inserts(stack):
            so_far = cost + INSERT * len(edits)
            moves = [(now, so_far + DELETE, ("D", None))]
            if fault not in ("blank", "duplicate"):
                stays = so_far + (TRUNCATED if fault == "truncated" else 0)
                if after := pushed(now, initial):
                    moves.append((after, stays, ("K", None)))
                moves += [(after, stays + REROLE, ("R", role)) for t, role in GIVEN.items() if (after := pushed(now, t))]
            for after, total, edit in moves:
                audit = "I" * len(edits) + edit[0]
                key = (total, rank, audit)
                if (at := top(after)) not in found or key < found[at][0]:
                    found[at] = (key, after, i, (*edits, edit))
    least = min(key[0] for key, *_ in found.values())
    kept = [entry for entry in found.values() if entry[0][0] <= least + BEHIND]
    order = sorted(range(len(kept)), key=lambda j: kept[j][0][1:])
    rank = {j: r for r, j in enumerate(order)}
    return (tuple((after, key[0] - least, rank[j]) for j, (key, after, _, _) in enumerate(kept)), least,
            tuple((i, edits) for _, _, i, edits in kept))


@lru_cache(maxsize=1 << 12)
def finished(parser: Parser) -> tuple[int, int, tuple]:
    """(stack of the cheapest whole log, its cost, insertions at the end)."""
    (cost, *_), i, edits = min(((cost + INSERT * len(edits), rank, "I" * len(edits)), i, edits)
                              for i, (stack, cost, rank) in enumerate(parser) for now, edits in _with_inserts(stack) if pushed(now, END))
    return i, cost, edits


class _Log:
    """A conversation that is being parsed: rows that wait, each with the moves that lead to the stacks behind it."""

    def __init__(self) -> None:
        self.parser, self.waiting, self.limit = FRESH, [], WAIT

    def feed(self, row: tuple, initial: str, fault: str) -> list[tuple]:
        self.parser, _, moves = stepped(self.parser, initial, fault)
        self.waiting.append((row, moves))
        return self._final() if len(self.waiting) >= self.limit else []

    def _path(self, end: int, stack: int) -> tuple[list[tuple], int]:
        """Edits of the first `end` waiting rows on the way to a stack behind them, and the stack where it begins."""
        out = []
        for row, moves in reversed(self.waiting[:end]):
            stack, edits = moves[stack]
            out.append((row, edits))
        return out[::-1], stack

    def _final(self) -> list[tuple]:
        stacks = set(range(len(self.parser)))
        for end in range(len(self.waiting) - 1, 0, -1):
            stacks = {self.waiting[end][1][j][0] for j in stacks}
            if len(stacks) == 1:
                out, _ = self._path(end, stacks.pop())
                self.waiting, self.limit = self.waiting[end:], WAIT
                return out
        self.limit *= 2
        return []

    def close(self) -> list[tuple]:
        stack, _, edits = finished(self.parser)
        out, _ = self._path(len(self.waiting), stack)
        return [*out, (None, edits)]


def _same(a: Any, b: Any) -> bool:
    return a == b or (a != a and b != b)


def checked(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, fault) with all rows of a conversation in one partition, in order.

    The order is by turn, null first, then role and text. A fault is the first that applies: blank (only white space),
    duplicate (role and text stand earlier in the conversation), truncated (the last character that is not white
    space is none of `.!?`); else it is null. A null role or text counts as one space.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first()))
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = (F.when(last == "", "blank").when(F.col("again") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated"))
    return rows.withColumn("again", again).withColumn("fault", fault).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again").drop("again")


def _edits_schema(turns: DataFrame) -> T.StructType:
    kinds = turns.schema
    return T.StructType([kinds["conv_id"], T.StructField("step", T.LongType()), T.StructField("edit", T.StringType()), kinds["turn"],
                         T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("old_role", T.StringType()),
                         T.StructField("fault", T.StringType()), T.StructField("cost", T.LongType())])


def repairs(turns: DataFrame, **names: str) -> DataFrame:
    """(conv_id, step, edit, turn, role, text, old_role, fault, cost): the cheapest edits of every conversation in order.

    edit is Keep, Rerole, Delete or Insert; role and text are those after it, turn, old_role and fault those of the row
    (null for an insertion). Of edits with equal cost those with the ASCII-least initials are taken. Rows of a
    conversation lie together and in order. A repaired conversation is its steps that are no deletion. A role whose
    initial is none of the grammar, the empty role too, cannot be kept. Empty tables give no row. A conversation of
    any length is read as a stream; rows wait only until all stacks agree on their edits.
    """
    rows = checked(turns, **names)
    kind = _edits_schema(rows)
    cost = {"Keep": 0, "Rerole": REROLE, "Delete": DELETE, "Insert": INSERT}
    full = {name[0]: name for name in cost}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, log, key, step = [[] for _ in kind], None, None, 0
        arrow = [pa.int64()] * len(kind)

        def put(edits: list[tuple]) -> None:
            nonlocal step
            for row, moves in edits:
                for edit, role in moves:
                    name, given = full[edit], row if edit != "I" else (None, None, None, None)
                    turn, old, text, fault = given
                    stays = TRUNCATED if fault == "truncated" and edit in "KR" else 0
                    values = (key, step, name, turn, role or old, "" if edit == "I" else text, old, fault, cost[name] + stays)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    step += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], kind.names)
            for column in columns:
                column.clear()
            return out

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(5)]
            arrow = [types[0], pa.int64(), pa.string(), types[1], pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            for own, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if log is None or not _same(own, key):
                    if log is not None:
                        put(log.close())
                    log, key, step = _Log(), own, 0
                put(log.feed((turn, role, text, fault), role[:1], fault or ""))
                if len(columns[0]) >= 4096:
                    yield flush()
        if log is not None:
            put(log.close())
            yield flush()

    return rows.mapInArrow(parse, kind)


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of `repairs`: what was wrong, the cost, the audit and the digest of the result.

    Reads the steps as a stream, in the order in which `repairs` leaves them; only the audit, which is part of the row,
    grows with a conversation.
    """
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = T.StructType([edits.schema["conv_id"], *(T.StructField(n, T.LongType()) for n in longs), T.StructField("audit", T.StringType()),
                         T.StructField("repaired_sha256", T.StringType())])
    legal = ("su", "ua", "au")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, arrow = None, None, [], pa.int64()

        def close() -> None:
            n, first, last, distinct, audit, sha = state["n"], state["first"], state["last"], state["distinct"], state["audit"], state["sha"]
            gaps = 0 if last is None else last - first + 1 - distinct
            out.append((key, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"], "".join(audit), sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            kinds = [arrow, *[pa.int64()] * len(longs), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], kind.names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for own, _, edit, turn, role, text, old, fault, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or not _same(own, key):
                    if state is not None:
                        close()
                    key, state = own, {"n": dict.fromkeys((*FAULTS, "illegal", "cost"), 0), "first": None, "last": None, "distinct": 0,
                                       "audit": [], "sha": hashlib.sha256(), "before": None, "rows": 0}
                n = state["n"]
                n["cost"] += cost
                state["audit"].append(edit[0])
                if fault:
                    n[fault] += 1
                if old is not None:
                    if state["before"] is not None and state["before"] + old[:1] not in legal:
                        n["illegal"] += 1
                    state["before"] = old[:1]
                    if turn is not None and turn != state["last"]:
                        state["distinct"] += 1
                        state["first"], state["last"] = turn if state["first"] is None else state["first"], turn
                if edit != "Delete":
                    state["sha"].update((("\n" if state["rows"] else "") + f"{role}:{text}").encode())
                    state["rows"] += 1
            if len(out) >= 4096:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return edits.mapInArrow(read, kind)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table, a share of them damaged in ways that only crc32 of `conv_id:turn` decides.

    Of its remainder by 20, 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it
    the user's. Nulls count as one space.
    """
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(space("role")).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
        F.explode(F.when(what == 3, F.array(F.lit(1), F.lit(2))).when(what != 0, F.array(F.lit(1)))).alias("copy")).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """A row for every conversation of a damaged table; one without rows after the damage has zeros and empty results."""
    found = summaries(repairs(damaged(conversations))).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    default = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *(F.coalesce(name, default.get(name, F.lit(0).cast("long"))).alias(name) for name in found.columns[1:]))


#: The same by a recursive query over the rows of each conversation: tops 0 empty, 1 system, 2 user, 3 assistant.
SQL = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
            lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS what
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
        CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
    FROM damaged),
found AS (
    SELECT conv_id, turn, role, text, i, before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS illegal,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
    FROM numbered),
inserts(start, behind, inserted) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'),
    (2, 2, ''), (2, 3, 'I'), (2, 2, 'II'), (3, 3, ''), (3, 2, 'I'), (3, 3, 'II')),
shifts(start, initial, behind) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
    SELECT start, 'D' AS edit, '' AS initial, start AS behind, 3 AS cost FROM (SELECT DISTINCT start FROM inserts)
    UNION ALL SELECT start, 'K', initial, behind, 0 FROM shifts
    UNION ALL SELECT start, 'R', '', behind, 2 FROM shifts WHERE initial <> 's'),
walk AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS stack, 0::BIGINT AS cost, '' AS audit FROM found
    UNION ALL
    SELECT conv_id, i, stack, best.cost, best.audit FROM (
        SELECT w.conv_id, f.i, e.behind AS stack, min(struct_pack(cost := w.cost + 2 * length(n.inserted) + e.cost
            + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END, audit := w.audit || n.inserted || e.edit)) AS best
        FROM walk w JOIN found f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
            JOIN inserts n ON n.start = w.stack JOIN edits e ON e.start = n.behind
        WHERE CASE e.edit WHEN 'D' THEN true WHEN 'K' THEN f.fault NOT IN ('blank', 'duplicate') AND role[1] = e.initial
            ELSE f.fault NOT IN ('blank', 'duplicate') END
        GROUP BY w.conv_id, f.i, e.behind)),
ends AS (
    SELECT w.conv_id, min(struct_pack(cost := w.cost + 2 * length(n.inserted), audit := w.audit || n.inserted)) AS best
    FROM walk w JOIN (SELECT conv_id, max(i) AS last FROM found GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.last = w.i
        JOIN inserts n ON n.start = w.stack
    WHERE n.behind IN (0, 3) GROUP BY w.conv_id),
steps AS (
    SELECT conv_id, p, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
        count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS place
    FROM (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS p
          FROM ends WHERE best.audit <> '')),
said AS (
    SELECT s.conv_id, s.p, s.edit, s.place, CASE s.edit WHEN 'I' THEN '' ELSE f.text END AS text, CASE s.edit WHEN 'K' THEN f.role END AS role,
        bool_or(s.edit = 'K' AND s.place = 1 AND f.role[1] = 's') OVER (PARTITION BY s.conv_id) AS system
    FROM steps s JOIN found f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = greatest(s.i, 1)),
told AS (
    SELECT conv_id, string_agg(coalesce(role, CASE WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END)
        || ':' || text, chr(10) ORDER BY p) AS log
    FROM said WHERE edit <> 'D' GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (illegal) AS illegal
    FROM found GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(log, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
"""
