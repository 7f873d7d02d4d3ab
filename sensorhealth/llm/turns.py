"""Conversation structure repair by bidirectional Dijkstra over an edit lattice.

A lattice node is (rows consumed, last role so far); Keep, Rerole, Delete and Insert lead from node to
node until the roles read ``(s?(ua)+)?``. A forward and a reverse heap grow towards each other; after they
meet, both go on until no path of the same cost can be missing. Each edit of a node leads to one node only,
so the least audit is read off by taking the least edit at each node that lies on a cheapest path: first
along the forward side to a crossing, then along the reverse side. Time and memory are linear in the rows.

Rows travel once: each is sent as a fact (role, digest, flags) and as a text, dealt out by conversation and
sorted within partitions so that a conversation's facts come first. A task keeps the facts of one
conversation, finds its audit and then streams the texts through it; texts are never gathered.

Defined results: a null role or text is one space, a null conversation id is a conversation of its own, a
null turn comes first; rows of one turn are ordered by role, then by the digest of role and text; an empty
role has no initial and is reroled or deleted; repeated rows are duplicates; other columns are ignored; an
empty table gives no rows. A conversation's turns are one sequence, hence one task, as its digest is.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, REMOVE = 0, 1, 2  # what a row's fault asks for

#: Last role so far: none, system, user, assistant; conversations end at none or assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The role that must follow, system aside, and the states that a role may follow.
_NEXT = (USER, USER, ASSISTANT, USER)
_BEFORE = {SYSTEM: (NONE,), USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    keep_truncated: int = 5


@dataclass
class Lattice:
    """The edits of one conversation from its rows' role initials and faults.

    Node ``4 * at + role`` stands for ``at`` rows consumed and the last role so far.
    """

    initials: list[str]
    faults: bytearray
    costs: Costs = field(default_factory=Costs)

    def after(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, cost, node) that lead on from a node."""
        c, (at, role) = self.costs, divmod(node, 4)
        out = [("I", c.insert, 4 * at + _NEXT[role])]
        if at < len(self.faults):
            out.append(("D", c.delete, node + 4))
            if (fault := self.faults[at]) != REMOVE:
                more = c.keep_truncated * (fault == TRUNCATED)
                own = _INITIAL.get(self.initials[at])
                if own is not None and role in _BEFORE[own]:
                    out.append(("K", more, 4 * at + 4 + own))
                out.append(("R", c.rerole + more, 4 * at + 4 + _NEXT[role]))
        return out

    def before(self, node: int) -> list[tuple[str, int, int]]:
        """(edit, cost, node) that lead to a node."""
        c, (at, role), out = self.costs, divmod(node, 4), []
        if role in _NAMES:
            out += [("I", c.insert, 4 * at + b) for b in _BEFORE[role]]
        if at:
            out.append(("D", c.delete, node - 4))
            if (fault := self.faults[at - 1]) != REMOVE:
                more = c.keep_truncated * (fault == TRUNCATED)
                if _INITIAL.get(self.initials[at - 1]) == role:
                    out += [("K", more, 4 * at - 4 + b) for b in _BEFORE[role]]
                if role in _NAMES:
                    out += [("R", c.rerole + more, 4 * at - 4 + b) for b in _BEFORE[role]]
        return out


_FAR = 1 << 60


class _Side:
    """One of the two searches, on flat arrays; nodes of equal cost leave the heap in the order of the rows.

    A heap entry is one number: the cost, then how many rows the search has passed, then the role.
    """

    def __init__(self, rows: int, starts: list[int], reverse: bool):
        self.turn = 4 * rows if reverse else 0
        self.best = array("q", [_FAR]) * (4 * rows + 4)
        self.settled = bytearray(4 * rows + 4)
        self.order = array("q")
        self.heap: list[int] = []
        for node in starts:
            self._reach(node, 0)

    def _reach(self, node: int, cost: int) -> None:
        self.best[node] = cost
        role = node & 3
        passed = self.turn - (node - role) if self.turn else node - role
        heapq.heappush(self.heap, cost << 44 | passed | role)

    def _node(self, entry: int) -> int:
        role, passed = entry & 3, entry & ((1 << 44) - 4)
        return (self.turn - passed if self.turn else passed) + role

    def least(self) -> int:
        while self.heap and self.settled[self._node(self.heap[0])]:
            heapq.heappop(self.heap)
        return self.heap[0] >> 44 if self.heap else _FAR

    def settle(self, edges, other: _Side, bound: int) -> int:
        """Settle the nearest node; the cost of the best crossing so far."""
        node = self._node(heapq.heappop(self.heap))
        cost = self.best[node]
        self.settled[node] = 1
        self.order.append(node)
        bound = min(bound, cost + other.best[node])
        for _, more, to in edges(node):
            if cost + more < self.best[to]:
                self._reach(to, cost + more)
            bound = min(bound, cost + more + other.best[to])
        return bound


def cheapest(lattice: Lattice) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; of several the audit that sorts first."""
    n = len(lattice.faults)
    ends = (4 * n + NONE, 4 * n + ASSISTANT)
    forward, reverse = _Side(n, [NONE], False), _Side(n, list(ends), True)
    bound = _FAR
    # every node of every path of cost ``bound`` is settled by one side when the two heads exceed it
    while (a := forward.least()) + (b := reverse.least()) <= bound and max(a, b) < _FAR:
        if a <= b:
            bound = forward.settle(lattice.after, reverse, bound)
        else:
            bound = reverse.settle(lattice.before, forward, bound)
    far = reverse.settled
    for end in ends:  # known from the start, though the search may never have come to them
        far[end] = 1

    def crosses(node: int, cost: int) -> bool:
        return far[node] and cost + reverse.best[node] == bound

    useful = bytearray(4 * n + 4)  # settled forward and on a cheapest path

    def leads(node: int, cost: int) -> bool:
        return crosses(node, cost) or useful[node] and forward.best[node] == cost

    for node in reversed(forward.order):
        cost = forward.best[node]
        useful[node] = crosses(node, cost) or any(leads(to, cost + more) for _, more, to in lattice.after(node))
    audit, node, cost = [], NONE, 0
    while not (node in ends and cost == bound):
        edit, more, node = min(e for e in lattice.after(node) if leads(e[2], cost + e[1]))
        audit.append(edit)
        cost += more
    return bound, "".join(audit)


def text_rows(rows: DataFrame) -> DataFrame:
    """Conversation rows with nulls of role and text as one space."""
    blank = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows as ``text_rows`` damaged by the checksum of their place; ``copies`` is 0, 1 or 2."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return text_rows(rows).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _facts_and_texts(rows: DataFrame) -> DataFrame:
    """Each row as a fact (kind 0) and a text (kind 1), ``copies`` times; none at all as a mark of its id."""
    stripped = F.rtrim(F.col("text"), F.lit(_SPACE))
    state: Column = (
        F.when(F.trim(F.col("text"), F.lit(_SPACE)) == "", "blank")
        .when(F.substring(stripped, -1, 1).isin(".", "!", "?"), "sound")
        .otherwise("truncated")
    )
    told = rows.select(
        "conv_id", "turn", "role", "text", "copies", state.alias("state"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
    )

    def sent(kind: int, text: Column, state: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), state.alias("state"))

    none = F.lit(None).cast("string")
    both = F.array(sent(0, none, F.col("state")), sent(1, F.col("text"), none))
    copies = F.when(F.col("copies") == 0, F.array(sent(0, none, none))).otherwise(F.flatten(F.array_repeat(both, F.col("copies"))))
    return told.select("conv_id", "turn", "role", "digest", F.explode(copies).alias("_s")).select(
        "conv_id", "_s.kind", "turn", "role", "digest", "_s.text", "_s.state"
    )


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = f"position bigint, edit string, role string, text string, {REPORT}"


@dataclass
class Conversation:
    """What is kept of one conversation while its rows stream by."""

    conv_id: int | None
    costs: Costs
    initials: list[str] = field(default_factory=list)
    faults: bytearray = field(default_factory=bytearray)
    seen: set[bytes] = field(default_factory=set)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated"), 0))
    turns: int = 0
    first: int | None = None
    last: int | None = None
    audit: str | None = None
    at: int = 0  # edits applied
    position: int = 0  # rows given out
    state: int = NONE

    def fact(self, row: dict) -> None:
        if row["state"] is None:  # a dropped row
            return
        turn, fault = row["turn"], row["state"]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.turns, self.last = self.turns + 1, turn
        if fault != "blank" and row["digest"] in self.seen:
            fault = "duplicate"
        self.seen.add(row["digest"])
        if fault != "sound":
            self.counts[fault] += 1
        self.initials.append(row["role"][:1])
        self.faults.append({"sound": SOUND, "truncated": TRUNCATED}.get(fault, REMOVE))

    def report(self) -> tuple:
        self.seen.clear()
        cost, self.audit = cheapest(Lattice(self.initials, self.faults, self.costs))
        pairs = zip(self.initials, self.initials[1:])
        illegal = sum(a + b not in _LEGAL for a, b in pairs)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, -1, None, None, None, gaps, *self.counts.values(), illegal, cost, self.audit

    def _out(self, edit: str, role: str, text: str) -> tuple:
        self.position += 1
        return self.conv_id, self.position - 1, edit, role, text, *[None] * 7

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield self._out("I", _NAMES[self.state], "")

    def text(self, row: dict) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _INITIAL[row["role"][:1]]
            yield self._out(edit, row["role"], row["text"])
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield self._out(edit, _NAMES[self.state], row["text"])


def _repaired(rows: Iterator[dict], costs: Costs) -> Iterator[tuple]:
    now: Conversation | None = None

    def done() -> Iterator[tuple]:
        if now is not None:
            if now.audit is None:
                yield now.report()
            yield from now.inserts()

    for row in rows:
        if now is None or row["conv_id"] != now.conv_id:
            yield from done()
            now = Conversation(row["conv_id"], costs)
        if row["kind"] == 0:
            now.fact(row)
        else:
            if now.audit is None:
                yield now.report()
            yield from now.text(row)
    yield from done()


def _streamed(fn, schema: T.StructType):
    """A function over sorted rows as one over record batches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from batch.slice(at, 256).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, held = to_arrow_schema(schema), []

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else ([] for _ in kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        for row in fn(rows(batches)):
            held.append(row)
            if len(held) == 512:
                yield batch()
                held = []
        yield batch()

    return run


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Repaired conversations from (conv_id, turn, role, text[, copies]) without nulls in role and text.

    The row at position -1 of a conversation is its report; its repaired rows follow in order.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(REPAIRED)])
    dealt = _facts_and_texts(rows).repartition("conv_id")
    streamed = dealt.sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return streamed.mapInArrow(_streamed(lambda r: _repaired(r, costs), schema), schema)


def _digests(rows: Iterator[dict]) -> Iterator[tuple]:
    head = digest = None
    names = [f.split()[0] for f in REPORT.split(", ")]
    for row in rows:
        if row["position"] == -1:
            if head is not None:
                yield *head, digest.hexdigest()
            head, digest = (row["conv_id"], *(row[c] for c in names)), hashlib.sha256()
        else:
            line = f"{row['role']}:{row['text']}"
            digest.update((line if row["position"] == 0 else "\n" + line).encode())
    if head is not None:
        yield *head, digest.hexdigest()


def read_back(repaired: DataFrame) -> DataFrame:
    """The report of each conversation with the digest of its repaired rows, streamed where they are."""
    schema = T.StructType([repaired.schema["conv_id"], *T._parse_datatype_string(f"{REPORT}, repaired_sha256 string")])
    return repaired.mapInArrow(_streamed(_digests, schema), schema)
