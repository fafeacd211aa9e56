"""Repair of conversations: the cheapest edits that make the roles ``(s?(ua)+)?``, found on an edit lattice.

A conversation is its rows by turn (nulls first; rows of one turn by role, then
by the SHA-256 of their text). Its first fault counts for a row: blank (no
character but white space), duplicate (role and text seen earlier), truncated
(the last character that isn't white space ends no sentence). A row is kept
(cost 0), given the role that is due (Rerole, 1) or deleted (2; blank and
duplicate ones must be); an empty message of the role that is due can be
inserted anywhere (5); a truncated row that stays costs 5 more. The audit is the
initials of the edits in order. Of the cheapest audits the least by ASCII is
taken.

The lattice has a node for each number of rows done and each state of the
pattern. Two Dijkstra searches run on it, one from the start and one backwards
from the accepting ends, until no path of the least cost can be missing; the
least concatenation of both audits over all nodes and edges where they meet is
the answer.

How it is dealt out: rows are sorted by range, so a long conversation lies in
many partitions. A conversation that lies within one partition, and isn't long,
is solved at once. Others are cut into blocks, each solved from every state to
every state, and the blocks are put together in order. Rows that are equal in
all columns are counted before anything is shuffled, and what tells duplicates
is the first turn of a role and text, which is aggregated and joined. Texts are
shuffled once, in the end, to write the repaired messages; they stream by.

Nulls in role and text count as one space, a null conv_id is a conversation of
its own, a role whose initial isn't s, u or a can only be changed or deleted.
Other columns are ignored, an empty table gives no rows, texts may be of any length.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import ROWS_AT_ONCE, checkpointed

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a block of a long conversation.
BLOCK = 512
#: States of the pattern: nothing yet, after the system's row, after a user's, after an assistant's.
STATES = range(4)
ACCEPTING = (0, 3)
#: The role that is due in a state, and the state after it.
DUE = ("user", "user", "assistant", "user")
THEN = (2, 2, 3, 2)
#: Codes of a row: its initial, whether it must go, whether it is truncated.
OTHER, SYSTEM, USER, ASSISTANT, GOES, CUT = 0, 1, 2, 3, 4, 8
_DUE_CODE = (USER, USER, ASSISTANT, USER)
_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _onward(codes: bytes, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows done, state) of the edits that follow a node."""
    yield INSERT, "I", i, THEN[q]
    if i == len(codes):
        return
    code = codes[i]
    yield DELETE, "D", i + 1, q
    if not code & GOES:
        more = TRUNCATED if code & CUT else 0
        yield REROLE + more, "R", i + 1, THEN[q]
        if code & 3 == _DUE_CODE[q]:
            yield more, "K", i + 1, THEN[q]
        elif q == 0 and code & 3 == SYSTEM:
            yield more, "K", i + 1, 1


def _back(codes: bytes, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows done, state) of the edits that lead to a node, and where they start."""
    into = [p for p in STATES if THEN[p] == q]
    for p in into:
        yield INSERT, "I", i, p
    if i == 0:
        return
    code = codes[i - 1]
    yield DELETE, "D", i - 1, q
    if not code & GOES:
        more = TRUNCATED if code & CUT else 0
        for p in into:
            yield REROLE + more, "R", i - 1, p
            if code & 3 == _DUE_CODE[p]:
                yield more, "K", i - 1, p
        if q == 1 and code & 3 == SYSTEM:
            yield more, "K", i - 1, 0


class _Search:
    """One of the two searches. Nodes are settled by cost, then by how many rows lie behind.

    An edit of no cost takes one row along, so all that can lower a node's audit
    at its cost is settled before it.
    """

    def __init__(self, sources: Iterable[tuple[int, int]], edges: Callable, join: Callable[[str, str], str], behind: Callable[[int], int]):
        self.edges, self.join, self.behind = edges, join, behind
        self.label: dict[tuple[int, int], tuple[int, str]] = {node: (0, "") for node in sources}
        self.settled: set[tuple[int, int]] = set()
        self.heap = [(0, behind(i), i, q) for i, q in self.label]
        heapq.heapify(self.heap)

    def top(self) -> float:
        while self.heap and (self.heap[0][2:] in self.settled or self.label[self.heap[0][2:]][0] < self.heap[0][0]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, other: _Search) -> float:
        """Settle the top; the least cost of a path over the nodes it touches."""
        node = heapq.heappop(self.heap)[2:]
        self.settled.add(node)
        cost, audit = self.label[node]
        met = cost + other.label[node][0] if node in other.label else float("inf")
        for more, initial, i, q in self.edges(*node):
            to, found = (i, q), (cost + more, self.join(audit, initial))
            known = self.label.get(to)
            if known is None or found < known:
                self.label[to] = found
                if known is None or found[0] < known[0]:
                    heapq.heappush(self.heap, (found[0], self.behind(i), i, q))
            if to in other.label:
                met = min(met, found[0] + other.label[to][0])
        return met


def cheapest(codes: bytes, start: int = 0, goals: Iterable[int] = ACCEPTING) -> tuple[int, str] | None:
    """Least cost, and the least audit of that cost, from a state before the rows to one of the goals after them; None if there is no way."""
    n = len(codes)
    ahead = _Search([(0, start)], lambda i, q: _onward(codes, i, q), lambda audit, e: audit + e, lambda i: i)
    back = _Search([(n, q) for q in goals], lambda i, q: _back(codes, i, q), lambda audit, e: e + audit, lambda i: n - i)
    best: float = min((0 for node in ahead.label if node in back.label), default=float("inf"))
    # a node of a cheapest path that neither search has settled would need top + top <= best
    while (a := ahead.top()) + (b := back.top()) <= best and a + b < float("inf"):
        best = min(best, ahead.settle(back) if a <= b else back.settle(ahead))
    if best == float("inf"):
        return None
    audits = []
    ahead.settled.add((0, start))  # labels of sources are final too
    back.settled.update((n, q) for q in goals)
    for node in ahead.settled:
        cost, audit = ahead.label[node]
        if node in back.settled and cost + back.label[node][0] == best:
            audits.append(audit + back.label[node][1])
        for more, initial, i, q in _onward(codes, *node):
            if (i, q) in back.settled and cost + more + back.label[i, q][0] == best:
                audits.append(audit + initial + back.label[i, q][1])
    return int(best), min(audits)


@dataclass
class Chain:
    """Blocks of one conversation put together: for each state the cheapest way there.

    Audits are kept without what all of them begin with.
    """

    ways: dict[int, tuple[int, str]] = field(default_factory=lambda: {0: (0, "")})
    common: list[str] = field(default_factory=list)

    def add(self, paths: list[tuple[int, int, int, str]]) -> None:
        """``paths``: (state before, state after, cost, audit) of the next block."""
        ways: dict[int, tuple[int, str]] = {}
        for before, after, cost, audit in paths:
            if before in self.ways:
                way = self.ways[before][0] + cost, self.ways[before][1] + audit
                ways[after] = min(ways.get(after, way), way)
        head = os.path.commonprefix([audit for _, audit in ways.values()])
        self.common.append(head)
        self.ways = {q: (cost, audit[len(head) :]) for q, (cost, audit) in ways.items()}

    def end(self) -> tuple[int, str]:
        cost, audit = min(self.ways[q] for q in ACCEPTING if q in self.ways)
        return cost, "".join(self.common) + audit


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows' own columns without nulls in role and text, with the digest that tells texts apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


_ORDER = ("conv_id", "turn", "role", "digest")


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, blank, cut, seen): each distinct row once, with how often it is there and its faults.

    ``seen`` holds if its role and text have an earlier turn.
    """
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    blank = F.length(ends) == 0
    cut = ~blank & ~F.substring(ends, -1, 1).isin(".", "!", "?")
    marked = _keyed(rows).select(*_ORDER, blank.alias("blank"), cut.alias("cut"))
    alike = marked.groupBy(*_ORDER, "blank", "cut").agg(F.count("*").alias("n"))
    first = alike.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("what"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("what"))
    return alike.join(first, same).select(*_ORDER, "n", "blank", "cut", (F.struct("turn") > F.col("first")).alias("seen"))


@dataclass
class _Part:
    """What a block, or a chain of blocks, tells about its rows; ``add`` takes the next part of the conversation."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: int = -1
    last: int = -1

    def row(self, turn: int | None, code: int, kind: str | None) -> None:
        fault = {} if kind is None else {kind: 1}
        self.add(_Part(turns=int(turn is not None), first_turn=turn, last_turn=turn, first=code & 3, last=code & 3, **fault))

    def add(self, p: _Part) -> None:
        self.blank += p.blank
        self.duplicate += p.duplicate
        self.truncated += p.truncated
        self.illegal += p.illegal + (self.first >= 0 and (self.last, p.first) not in _PAIRS)
        # rows are in the order of turns, so a turn goes on from part to part or is over
        self.turns += p.turns - (p.first_turn is not None and p.first_turn == self.last_turn)
        self.first_turn = p.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if p.last_turn is None else p.last_turn
        self.first, self.last = (p.first if self.first < 0 else self.first), p.last

    def gaps(self) -> int:
        return 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)


_PART = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first int, last int"
_PATHS = "paths array<struct<before: int, after: int, cost: long, audit: string>>"


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T._parse_datatype_string(kind))


def _written(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class _Blocks:
    """Cuts the sorted rows of one partition into blocks and solves them."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.conv, self.no, self.began = None, 0, False
        self.at_edge = True  # the first conversation may have begun in the partition before
        self.codes, self.part = bytearray(), _Part()

    def take(self, conv, turn: int | None, role: str, n: int, blank: bool, cut: bool, seen: bool) -> None:
        if self.began and conv != self.conv:
            self.flush(more=False)
            self.no, self.at_edge = 0, False
        self.conv, self.began = conv, True
        initial = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
        for k in range(n):
            if len(self.codes) == BLOCK:
                self.flush(more=True)
            kind = "blank" if blank else "duplicate" if seen or k else "truncated" if cut else None
            code = initial | (GOES if kind in ("blank", "duplicate") else CUT if kind else 0)
            self.codes.append(code)
            self.part.row(turn, code, kind)

    def flush(self, more: bool) -> None:
        """``more``: the conversation goes on, or may go on in the next partition."""
        codes = bytes(self.codes)
        if self.no == 0 and not self.at_edge and not more:
            paths = [(0, 3, *cheapest(codes))]  # the whole conversation: any accepting end will do
        else:
            paths = [(p, q, *found) for p in STATES for q in STATES if (found := cheapest(codes, p, [q]))]
        p = self.part
        self.out.append((self.conv, TaskContext.get().partitionId(), self.no, paths, *vars(p).values()))
        self.no += 1
        self.codes, self.part = bytearray(), _Part()


def solved(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
    kind = dict(rows.dtypes)["conv_id"]
    ordered = coded(rows).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    shape = T._parse_datatype_string(f"conv_id {kind}, part int, no int, {_PATHS}, {_PART}")
    names, kinds = shape.fieldNames(), [_arrow(f.dataType.simpleString()) for f in shape.fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks.take(*row)
                if len(blocks.out) >= ROWS_AT_ONCE:
                    yield from _written(blocks.out, names, kinds)
                    blocks.out = []
        if blocks.began:
            blocks.flush(more=True)
        yield from _written(blocks.out, names, kinds)

    parts = ordered.select("conv_id", "turn", "role", "n", "blank", "cut", "seen").mapInArrow(cut, shape)
    # what a partition is, is settled before the blocks are shuffled
    parts = checkpointed(parts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    out_shape = T._parse_datatype_string(f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    out_names, out_kinds = out_shape.fieldNames(), [_arrow(f.dataType.simpleString()) for f in out_shape.fields]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, chain, sums = None, None, _Part()

        def close() -> None:
            if chain is not None:
                done.append((conv, sums.gaps(), sums.blank, sums.duplicate, sums.truncated, sums.illegal, *chain.end()))

        for batch in batches:
            for row_conv, _, _, paths, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain is None or row_conv != conv:
                    close()
                    conv, chain, sums = row_conv, Chain(), _Part()
                    if len(done) >= ROWS_AT_ONCE:
                        yield from _written(done, out_names, out_kinds)
                        done.clear()
                chain.add([(p["before"], p["after"], p["cost"], p["audit"]) for p in paths])
                sums.add(_Part(*numbers))
        close()
        yield from _written(done, out_names, out_kinds)

    return parts.mapInArrow(put_together, out_shape)


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text): each conversation's audit, then its rows in order, in one partition."""
    texts = _keyed(rows).select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    heads = audits.select("conv_id", F.lit(0).alias("part"), F.col("audit").alias("text"))
    both = texts.unionByName(heads, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    return ordered.select("conv_id", (F.col("part") == 0).alias("is_audit"), "role", "text")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None, None, None) where a conversation begins, then (conv_id, edit, role, text) of each edit; deleted rows have their own role and text."""
    audit, at, state = "", 0, 0

    def inserted(conv) -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv, "I", DUE[state], ""
            at, state = at + 1, THEN[state]

    for whole in batches:
        for first in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(first, ROWS_AT_ONCE)
            for conv, is_audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_audit:
                    audit, at, state = text, 0, 0
                    yield conv, None, None, None
                else:
                    edit = audit[at]
                    at += 1
                    if edit == "R":
                        role = DUE[state]
                    if edit != "D":
                        state = 1 if edit == "K" and role[:1] == "s" else THEN[state]
                    yield conv, edit, role, text
                # those before the next row, or at the end
                yield from inserted(conv)


def messages(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired messages of conversations in order, from ``solved``'s audits."""
    shape = T._parse_datatype_string(f"conv_id {dict(rows.dtypes)['conv_id']}, position long, edit string, role string, text string")
    names, kinds = shape.fieldNames(), [_arrow(f.dataType.simpleString()) for f in shape.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position = [], 0
        for conv, edit, role, text in _walk(batches):
            if edit is None:
                position = 0
            elif edit != "D":
                out.append((conv, position, edit, role, text))
                position += 1
            if len(out) >= ROWS_AT_ONCE:
                yield from _written(out, names, kinds)
                out = []
        yield from _written(out, names, kinds)

    return _with_audits(rows, audits).mapInArrow(run, shape)


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired ``role:text``, joined by newlines."""
    shape = T._parse_datatype_string(f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string")
    names, kinds = shape.fieldNames(), [_arrow(f.dataType.simpleString()) for f in shape.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_conv, sha, empty = None, None, True
        for conv, edit, role, text in _walk(batches):
            if edit is None:
                if sha is not None:
                    out.append((open_conv, sha.hexdigest()))
                open_conv, sha, empty = conv, hashlib.sha256(), True
            elif edit != "D":
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if len(out) >= ROWS_AT_ONCE:
                yield from _written(out, names, kinds)
                out = []
        if sha is not None:
            out.append((open_conv, sha.hexdigest()))
        yield from _written(out, names, kinds)

    return _with_audits(rows, audits).mapInArrow(run, shape)


def damaged(conversations: DataFrame) -> DataFrame:
    """Planted faults, by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 sets role user. Nulls are one space."""
    blank = F.lit(" ")
    kind: Column = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def report(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """What ``solved`` and ``digests`` tell of each conv_id of ``wanted``; zeros, an empty audit and the hash of nothing for one without rows."""
    found = checkpointed(solved(rows))
    hashed = digests(rows, found.select("conv_id", "audit"))
    ids = wanted.select(F.col("conv_id").alias("id")).distinct()
    hashed = hashed.select(F.col("conv_id").alias("hashed_id"), "repaired_sha256")
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("id").eqNullSafe(F.col("hashed_id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
