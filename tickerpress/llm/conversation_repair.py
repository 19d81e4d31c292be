"""Cheapest repair of conversations by a Viterbi search whose survivors coalesce.

A repaired conversation has the roles of ``(s?(ua)+)?``: an optional system turn, then pairs of
user and assistant.  Rows are kept (cost 0), given the role user or assistant (3) or deleted (4;
blank and repeated rows have to be); a user or assistant turn without text may be inserted
anywhere (3); a row that stays although its text breaks off costs 3 more.  Of the cheapest
edit scripts the one whose letters (D, I, K, R) are least in ASCII is taken.

The search goes through a conversation once.  A survivor per state hangs on a tree of
backpointers with reference counts; as soon as all survivors share an ancestor, the edits up
to it are given out and forgotten, so memory holds the unresolved end only.  A state whose
cost is above another's by more than any continuation can make up is dropped, which is what
lets survivors meet.

Inserts are booked with the row before which they stand.  Two scripts up to the same row then
never are prefixes of each other, so the order of the survivors' whole scripts decides
every tie that their continuations meet in, and is carried along as a rank.

A conversation that lies in several pieces (see ``ordering``) is searched piece by piece in
parallel: a piece first gives, for each state it may start in, cost and rank of each state it may
end in; these small tables are chained per conversation, and each piece is then decoded between its
two states.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.llm.ordering import in_order
from tickerpress.session import write_through

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = (EMPTY, SYSTEM, USER, ASSISTANT), (EMPTY, ASSISTANT)
RELABEL, DELETE, INSERT, BROKEN = 3, 4, 3, 3
#: Where a turn with this initial leads from a state, if it may follow.
NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The initial that may be inserted or given in a state.
WANTED = {EMPTY: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
ROLE = {"u": "user", "a": "assistant"}
#: LEAD[p][q]: what p at most pays more than q for one and the same continuation of q.
LEAD = {EMPTY: {SYSTEM: 0, USER: 3, ASSISTANT: 0}, SYSTEM: {EMPTY: 6, USER: 3, ASSISTANT: 6},
        USER: {EMPTY: 7, SYSTEM: 3, ASSISTANT: 3}, ASSISTANT: {EMPTY: 4, SYSTEM: 0, USER: 3}}
#: Characters of a text that place it among rows of the same turn and role when rows are dealt out.
TIE = 64
#: Rows that a piece reads before it first looks for a shared ancestor.
PATIENCE = 32

BLANKS, STOPS = " \t\n\x0b\x0c\r", "[.!?]"
EDITS = ("part long, seq long, edit string, times long, turn long, role string, text string, old_role string, fault string")
REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows harmed by the checksum of ``conv_id:turn`` (nulls: one space): some are dropped, emptied, cut, doubled or relabelled."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times")).where("times > 0")


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation: conv_id and the columns of ``EDITS``.

    Reads conv_id, turn, role, text and, if there, times (a row stands for so many equal ones).
    Rows are taken by turn, null first, then role, then text.  The order of a conversation's edits is
    (part, seq).  ``edit`` is K, R, D or I, ``times`` of them in a row; role and text are the
    repaired ones (null if deleted), old_role that of the row (null if inserted), fault is
    blank, duplicate, truncated or null, each row having its first.

    Null roles and texts are one space.  Rows without conv_id are one conversation.  Equal rows
    are aggregated before they are shuffled.  Long texts are held only while their row is
    unresolved.  An empty table has no edits.
    """
    blank, times = F.lit(" "), F.col("times") if "times" in conversations.columns else F.lit(1)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), times.cast("long").alias("times"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    order = ["conv_id", "turn", "role", "text"]
    ordered = in_order(counted, [*order[:3], F.substring("text", 1, TIE)], order, "repair")
    flagged = write_through(_faults(ordered), "repair-faults")
    plan = _plan_pieces(flagged)
    located = flagged.join(plan, flagged.conv_id.eqNullSafe(plan.of) & (flagged.part == plan.piece), "left").drop("of", "piece")
    return (located.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
            .mapInArrow(_decode, "conv_id long, " + EDITS))


def report(edits: DataFrame) -> DataFrame:
    """Per conversation of ``edits`` the columns of ``REPORT``.

    A digest and a script are one string each, so the edits of one conversation pass
    through one task, in order and one batch at a time; only the script is held.
    """
    return edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(
        _report, "conv_id long, " + REPORT)


def _faults(ordered: DataFrame) -> DataFrame:
    """Adds must_go (blank or seen before, for all or all but the first of equal rows) and fault."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    digest = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    keyed = ordered.withColumn("digest", digest)
    same = keyed.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("seen")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = keyed.join(same, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("seen")), "left")
    fault = (F.when(last == "", "blank").when(F.col("at") > F.col("first"), "duplicate")
             .when(~last.isin(*".!?"), "truncated"))
    return joined.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "times", "at", "part", "fault")


class Node:
    """A step of a script: the letters it adds and the row they treat."""

    __slots__ = ("parent", "refs", "letters", "row")

    def __init__(self, parent: "Node | None", letters: str, row):
        self.parent, self.refs, self.letters, self.row = parent, 0, letters, row
        if parent is not None:
            parent.refs += 1


def release(node: Node | None) -> None:
    """Drop one reference; branches that nobody holds go, up to the fork."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        above, node.parent = node.parent, None
        node = above


#: state -> (cost, rank of its script among the survivors, node)
Survivors = dict[int, tuple[int, int, Node | None]]


def _inserted(survivors: Survivors) -> list[tuple[int, int, int, str, Node | None]]:
    """The survivors and what one or two inserts make of them: state, cost, rank, letters, node."""
    out = []
    for state, (cost, rank, node) in survivors.items():
        letters = ""
        for _ in range(3):
            out.append((state, cost, rank, letters, node))
            state, cost, letters = NEXT[WANTED[state]][state], cost + INSERT, letters + "I"
    return out


def step(survivors: Survivors, initial: str, must_go: bool, broken: bool, row=None, tree: bool = True) -> Survivors:
    """Survivors after one more row."""
    best: dict[int, tuple] = {}

    def offer(state, cost, rank, letters, node):
        held = best.get(state)
        if held is None or (cost, rank, letters) < held[:3]:
            best[state] = (cost, rank, letters, node)

    extra = BROKEN if broken else 0
    for state, cost, rank, letters, node in _inserted(survivors):
        offer(state, cost + DELETE, rank, letters + "D", node)
        if must_go:
            continue
        to = NEXT.get(initial, {}).get(state)
        if to is not None:
            offer(to, cost + extra, rank, letters + "K", node)
        offer(NEXT[WANTED[state]][state], cost + RELABEL + extra, rank, letters + "R", node)
    alive = {q: c for q, c in best.items() if not any(best[p][0] + LEAD[p][q] < c[0] for p in best if p != q)}
    ranks = {q: r for r, q in enumerate(sorted(alive, key=lambda q: alive[q][1:3]))}
    after = {}
    for q, (cost, _, letters, node) in alive.items():
        child = None
        if tree:
            child = Node(node, letters, row)
            child.refs = 1  # the survivor's own
        after[q] = (cost, ranks[q], child)
    if tree:
        for _, _, node in survivors.values():
            release(node)
    return after


def end(survivors: Survivors) -> tuple[int, str]:
    """The state and the inserts after the last row that make the best whole script."""
    state_of: dict[tuple, int] = {}
    for start, (cost, rank, _) in survivors.items():
        for state, full, _, letters, _ in _inserted({start: (cost, rank, None)}):
            if state in FINAL:
                state_of.setdefault((full, rank, letters), start)
    best = min(state_of)
    return state_of[best], best[2]


class Decoder:
    """Streams rows in and resolved (letters, row) steps out."""

    def __init__(self, state: int):
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.survivors: Survivors = {state: (0, 0, self.root)}
        self.since, self.patience = 0, PATIENCE

    def feed(self, initial: str, must_go: bool, broken: bool, row) -> list[tuple[str, object]]:
        self.survivors = step(self.survivors, initial, must_go, broken, row)
        self.since += 1
        return self._resolve() if self.since >= self.patience else []

    def _resolve(self) -> list[tuple[str, object]]:
        """Steps up to the last ancestor that all survivors share."""
        node, chain = next(iter(self.survivors.values()))[2], []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        out = []
        while chain and self.root.refs == 1 and not self._is_survivor(self.root):
            self.root = chain.pop()
            self.root.parent = None
            out.append((self.root.letters, self.root.row))
            self.root.letters, self.root.row = "", None
        # Look again after as many rows as are still open, so that looking costs a constant a row.
        self.since, self.patience = 0, max(PATIENCE, len(chain))
        return out

    def _is_survivor(self, node: Node) -> bool:
        return any(node is held for _, _, held in self.survivors.values())

    def finish(self, state: int | None) -> tuple[list[tuple[str, object]], str]:
        """The open steps up to ``state`` (None: the best end), and the inserts after them."""
        tail = ""
        if state is None:
            state, tail = end(self.survivors)
        node, chain = self.survivors[state][2], []
        while node is not self.root:
            chain.append((node.letters, node.row))
            node = node.parent
        return chain[::-1], tail


def _flags(role: str, fault: str | None) -> tuple[str, bool, bool]:
    return role[:1], fault in ("blank", "duplicate"), fault == "truncated"


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows of equal (conv_id, part), as itertools.groupby gives them."""
    return itertools.groupby(rows, key=lambda r: r[:2])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, per state before it: cost and rank of each state after it."""
    out = []
    for (conv, part), rows in _pieces(_rows(batches, ["conv_id", "part", "role", "fault", "times"])):
        tables = {q: {q: (0, 0, None)} for q in STATES}
        for _, _, role, fault, times in rows:
            flags = _flags(role, fault)
            for q in STATES:
                tables[q] = step(tables[q], *flags, tree=False)
                if times > 1:
                    tables[q] = {s: (cost + DELETE * (times - 1), rank, None) for s, (cost, rank, _) in tables[q].items()}
        out += [(conv, part, q, to, cost, rank) for q, table in tables.items() for to, (cost, rank, _) in table.items()]
    columns = list(zip(*out)) or [[]] * 6
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                     ["conv_id", "part", "before", "after", "cost", "rank"])


def _chain(tables: pd.DataFrame) -> pd.DataFrame:
    """States before and after each piece of one conversation; ``after`` is null for the last."""
    parts = sorted(tables["part"].unique())
    by_part = {p: {} for p in parts}
    for row in tables.itertuples():
        by_part[row.part].setdefault(row.before, {})[row.after] = (int(row.cost), int(row.rank))
    survivors, back = {EMPTY: (0, 0, None)}, []
    for p in parts:
        best: dict[int, tuple] = {}
        for q, (cost, rank, _) in survivors.items():
            for to, (more, inner) in by_part[p].get(q, {}).items():
                best[to] = min(best.get(to, (float("inf"),)), (cost + more, rank, inner, q))
        ranks = {q: r for r, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
        survivors = {q: (c[0], ranks[q], None) for q, c in best.items()}
        back.append({q: c[3] for q, c in best.items()})
    state, _ = end(survivors)
    found, after = [], None
    for p, came in zip(reversed(parts), reversed(back)):
        found.append((p, came[state], after))
        state = after = came[state]
    return pd.DataFrame({"of": pd.array([tables["conv_id"].iloc[0]] * len(found), dtype="Int64"), "piece": [f[0] for f in found], "before": [f[1] for f in found],
                         "after": pd.array([f[2] for f in found], dtype="Int32")})


def _plan_pieces(flagged: DataFrame) -> DataFrame:
    """of, piece, before, after for the conversations that lie in several pieces.

    There are no more of those than ranges, and a conversation has no more pieces than ranges.
    """
    pieces = flagged.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("piece")).agg(F.count(F.lit(1)).alias("n"))
    split = pieces.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of")
    slim = flagged.select("conv_id", "part", "at", F.substring("role", 1, 1).alias("role"), "fault", "times")
    rows = slim.join(split, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    tables = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at").mapInArrow(
        _summaries, "conv_id long, part long, before int, after int, cost long, rank int")
    return tables.groupBy("conv_id").applyInPandas(_chain, "of long, piece long, before int, after int")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each piece between the states it was given (none: a whole conversation)."""
    names = ["conv_id", "part", "seq", "edit", "times", "turn", "role", "text", "old_role", "fault"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 4
    out: list[tuple] = []

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 10, types)], names)
        out.clear()
        return made

    columns = ["conv_id", "part", "before", "after", "turn", "role", "text", "times", "fault"]
    for (conv, part), rows in _pieces(_rows(batches, columns)):
        decoder, after, writer = None, None, _Writer(conv, part, out)
        for _, _, before, after, turn, role, text, times, fault in rows:
            if decoder is None:
                writer.state = EMPTY if before is None else before
                decoder = Decoder(writer.state)
            for letters, row in decoder.feed(*_flags(role, fault), (turn, role, text, times, fault)):
                writer.write(letters, row)
            if len(out) >= 2000:
                yield batch()
        steps, tail = decoder.finish(after)
        for letters, row in steps:
            writer.write(letters, row)
        writer.write(tail, None)
        if len(out) >= 2000:
            yield batch()
    yield batch()


class _Writer:
    """Turns letters into edit rows; the state says which role an insert or a relabelling gives."""

    def __init__(self, conv: int | None, part: int, out: list[tuple]):
        self.conv, self.part, self.out, self.state, self.seq = conv, part, out, EMPTY, 0

    def write(self, letters: str, row: tuple | None) -> None:
        for letter in letters:
            if letter == "I":
                initial = WANTED[self.state]
                self._add("I", 1, None, ROLE[initial], "", None, None)
                self.state = NEXT[initial][self.state]
                continue
            turn, role, text, times, fault = row
            if letter == "D":
                self._add("D", 1, turn, None, None, role, fault)
            else:
                initial = WANTED[self.state] if letter == "R" else role[0]
                self._add(letter, 1, turn, ROLE[initial] if letter == "R" else role, text, role, fault)
                self.state = NEXT[initial][self.state]
            if times > 1:
                self._add("D", times - 1, turn, None, None, role, fault if fault == "blank" else "duplicate")

    def _add(self, *edit) -> None:
        self.out.append((self.conv, self.part, self.seq, *edit))
        self.seq += 1


class _Summary:
    """Figures of one conversation, edit by edit."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.least = self.most = self.turn = None
        self.turns = self.illegal = self.cost = 0
        self.initial: str | None = None
        self.audit: list[str] = []
        self.digest, self.empty = hashlib.sha256(), True

    def add(self, edit, times, turn, role, text, old_role, fault) -> None:
        self.audit.append(edit * times)
        if fault:
            self.faults[fault] += times
        self.cost += times * {"K": 0, "R": RELABEL, "D": DELETE, "I": INSERT}[edit]
        if edit != "D":
            if fault == "truncated":
                self.cost += BROKEN
            self.digest.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
            self.empty = False
        if edit == "I":
            return
        initial = old_role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += times - 1  # two equal initials
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = ["conv_id", *(c.split()[0] for c in REPORT.split(", "))]
    columns = ["conv_id", "edit", "times", "turn", "role", "text", "old_role", "fault"]
    out, summary, of = [], None, None
    for conv, *edit in _rows(batches, columns):
        if summary is None or conv != of:
            if summary is not None:
                out.append((of, *summary.row()))
            summary, of = _Summary(), conv
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        summary.add(*edit)
    if summary is not None:
        out.append((of, *summary.row()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 9, types)], names)


def repaired(conversations: DataFrame, original: DataFrame) -> DataFrame:
    """``report`` of the repaired ``conversations`` for every conv_id of ``original``; those without rows have zeros."""
    found = report(repair(conversations)).withColumnRenamed("conv_id", "of")
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("conv_id", *(F.coalesce(c, F.lit(empty.get(c, 0))).alias(c)
                                      for c in (x.split()[0] for x in REPORT.split(", "))))
