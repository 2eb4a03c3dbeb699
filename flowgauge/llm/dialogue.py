"""Repair of conversations whose messages were lost, emptied, cut, repeated or given a wrong role.

A conversation should be an optional system message, then user and assistant in turn, an
assistant last; or empty. The cheapest edits are a shortest path through a lattice: a node is
a message and the role that went before (:data:`START`, system, user or assistant), an arc
keeps, gives another role to or deletes the message, or inserts one before it.

Paths come from the auction algorithm. Every node has a price, never above the cost of an arc
plus the price it leads to. A path grows from an origin along arcs that meet this bound; where
none does, the price of the last node is raised to the least such sum and the path drops the
node. Origins are taken from the last message to the first and prices are kept, so that a path
ends as soon as it meets a node that was an origin before, whose price is its distance to the
end. Once all nodes were origins, the arcs that meet their bound are exactly those of shortest
paths, and following the least letter gives the first of all cheapest edits in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowgauge.llm.common import SPACE_CHARS
from flowgauge.runtime import cut_lineage, scratch_path

#: States of the lattice: the role before, and no message yet.
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE_COST, INSERT_COST, ROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a message whose role the repair chooses.
_CHOSEN = (USER, USER, ASSISTANT, USER)
#: By initial of the role: the state before a message and the one after it, where it may stay.
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_LEGAL = ("su", "ua", "au")
FAULTS = (None, "truncated", "duplicate", "blank")
#: Stands for the end of a conversation in place of an initial and a fault.
FINISH = ("", -1)
#: Characters of repaired text, or edits, that travel together where a conversation is put together from parts.
PIECE = 1 << 20


# --- lattice ---------------------------------------------------------------------


def _arcs(kind: tuple[str, int]) -> list[list[tuple[str, int, int]]]:
    """Letter, cost and target of the arcs from each state; targets from 4 on lie behind the message."""
    initial, fault = kind
    out = []
    for state in range(4):
        chosen = _CHOSEN[state]
        arcs = [("I", INSERT_COST, chosen)]
        if kind == FINISH:
            arcs += [("", 0, 4 + state)] if state in (START, ASSISTANT) else []
        else:
            arcs.append(("D", DELETE_COST, 4 + state))
            if fault <= 1:
                penalty = TRUNCATED_COST * fault
                arcs.append(("R", ROLE_COST + penalty, 4 + chosen))
                kept = _KEPT.get(initial, {}).get(state)
                arcs += [("K", penalty, 4 + kept)] if kept is not None else []
        out.append(arcs)
    return out


def _auction(arcs: list[list[tuple[str, int, int]]], prices: list, origin: int) -> None:
    """Raise prices until a path from the origin along tight arcs has left the message."""
    path = [origin]
    while path[-1] < 4:
        node = path[-1]
        least, target = min((cost + prices[to], to) for _, cost, to in arcs[node])
        if prices[node] < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(target)


@lru_cache(maxsize=1 << 16)
def _before_message(kind: tuple[str, int], behind: tuple) -> tuple[tuple, tuple]:
    """Prices of the states before a message, and the least letter among the tight arcs of each.

    ``behind`` are the prices of the states behind it, the least of them 0, None where no path
    leads on. The prices of a conversation differ little, so few cases are ever worked out.
    """
    arcs = _arcs(kind)
    open_ = {4 + s for s, price in enumerate(behind) if price is not None}
    while more := {s for s in range(4) if any(to in open_ for _, _, to in arcs[s])} - open_:
        open_ |= more
    arcs = [[arc for arc in of if arc[2] in open_] for of in arcs]
    prices = [0] * 4 + list(behind)
    for origin in range(4):
        if origin in open_:
            _auction(arcs, prices, origin)
    tight = [
        min((a for a in arcs[s] if prices[s] == a[1] + prices[a[2]]), default=None) if s in open_ else None for s in range(4)
    ]
    return tuple(prices[s] if s in open_ else None for s in range(4)), tuple(tight)


def solve(kinds: Sequence[tuple[str, int]], behind: tuple) -> tuple[tuple, list]:
    """Prices before the first of some messages, given those behind the last, and the tight arcs of each."""
    steps: list = [None] * len(kinds)
    total = 0
    for i in range(len(kinds) - 1, -1, -1):
        least = min(p for p in behind if p is not None)
        total += least
        behind, steps[i] = _before_message(kinds[i], tuple(None if p is None else p - least for p in behind))
    return tuple(None if p is None else p + total for p in behind), steps


#: Prices behind the last message of a conversation.
_LAST = solve([FINISH], (0, None, None, 0))[0]


def trace(steps: list, state: int) -> Iterator[tuple[int, str, int]]:
    """Message, letter and state after it, along the tight arcs of the least letters."""
    for i, step in enumerate(steps):
        while True:
            letter, _, target = step[state]
            state = target % 4
            if letter:
                yield i, letter, state
            if target >= 4:
                break


def _exit(steps: list, state: int) -> int:
    for step in steps:
        while True:
            target = step[state][2]
            state = target % 4
            if target >= 4:
                break
    return state


# --- messages in order -----------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Messages with the faults that a checksum of ``conv_id:turn`` deals them, and ``times`` each occurs.

    NULLs stand as one space in the checksum, the role and the text. A lost message occurs 0 times.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    deal = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(deal == 4, F.lit("user")).otherwise(shown("role")).alias("role"),
        F.when(deal == 1, F.lit(""))
        .when(deal == 2, F.regexp_replace(shown("text"), "[.!?]", ""))
        .otherwise(shown("text"))
        .alias("text"),
        F.when(deal == 0, 0).when(deal == 3, 2).otherwise(1).alias("times"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct messages by conversation, turn (NULL first), role and text, in partitions that are ranges.

    Columns: conv, turn, role, text, times, fault (a place in :data:`FAULTS`; that of the first
    occurrence) and the place, whose upper bits number the partition.
    """
    spark = rows.sparkSession
    gone = F.col("times") == 0
    columns = {"conv": "conv_id", "turn": "turn", "role": "role", "text": "text"}
    named = rows.select(
        F.col("conv_id").alias("conv"),
        *[F.when(~gone, F.col(old)).alias(new) for new, old in columns.items() if new != "conv"],
        F.col("times").cast("bigint").alias("times"),
    )
    # Copies meet before anything else, so that a message repeated without end is one row.
    met = named.groupBy(*columns).agg(F.sum("times").alias("times"))
    stripped = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    hashes = [F.xxhash64(F.lit(seed), "conv", "role", "text").alias(f"h{seed}") for seed in (1, 2)]
    path = scratch_path(spark, "messages")
    met.select("*", (F.length(stripped) == 0).alias("blank"), *hashes).write.parquet(path)
    kinds = dict(named.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", times bigint, blank boolean, h1 bigint, h2 bigint"
    met = spark.read.schema(schema).parquet(path)
    said = met.where("NOT blank").groupBy("h1", "h2")
    said = said.agg(F.count("*").alias("n"), F.min("turn").alias("since"), F.bool_or(F.col("turn").isNull()).alias("always"))
    path = scratch_path(spark, "said-again")
    said.where("n > 1").select("h1", "h2", "since", "always").write.parquet(path)
    said = spark.read.schema(f"h1 bigint, h2 bigint, since {kinds['turn']}, always boolean").parquet(path)
    again = F.col("turn").isNotNull() & (F.col("always") | (F.col("turn") > F.col("since")))
    ends = F.substring(stripped, -1, 1).isin(".", "!", "?")
    fault = F.when(F.col("blank"), 3).when(again, 2).when(~ends, 1).otherwise(0)
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]
    # Ranges are cut by a short prefix of the texts, which the driver samples; ties fall into one range.
    ranges = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.substring("text", 1, 64)]
    return cut_lineage(
        met.join(said, ["h1", "h2"], "left")
        .select(*columns, "times", fault.alias("fault"))
        .repartitionByRange(*ranges)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Neighbouring rows of one conversation, without its id."""
    conv, held = None, []
    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and own != conv:
                yield conv, held
                held = []
            conv = own
            held.append(tuple(row))
    if held:
        yield conv, held


def _batches(rows: Iterator[tuple], names: Sequence[str], kinds: Sequence[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=list(names))

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    if held:
        yield out()


def _kinds(rows: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    """Initial and fault of each occurrence of messages given as role, times and fault."""
    out = []
    for role, times, fault in rows:
        if times:
            out.append(((role or "")[:1], fault))
            out += [((role or "")[:1], max(fault, 2))] * (times - 1)
    return out


# --- conversations over several partitions ----------------------------------------


@dataclass(frozen=True)
class _Part:
    """What one partition must know of a conversation that begins before or goes on behind it."""

    behind: tuple
    state: int
    last: bool


def _spread(ordered: DataFrame, kind: str) -> dict[tuple[int, object], _Part]:
    """Parts of the conversations that lie in several partitions, by partition and conversation.

    Each partition gives the distances between the states at both ends of its first and last
    conversation, so the driver gets two short rows from each. Prices are carried along such a
    conversation from its end, then states from its start.
    """
    narrow = ordered.select("conv", "role", "times", "fault", "place")
    arrow = to_arrow_type(ordered.schema["conv"].dataType)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list]]:
        last = None
        for at, (conv, rows) in enumerate(_conversations(batches)):
            found = (rows[0][-1] >> 33, conv, [row[:3] for row in rows])
            if at == 0:
                yield found
            else:
                last = found
        if last:
            yield last

    def measured(of) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = ((part, conv, of(part, conv, _kinds(rows))) for part, conv, rows in ends(batches))
            known = (row for row in found if row[2] is not None)
            yield from _batches(known, ["part", "conv", "v"], [pa.int64(), arrow, pa.list_(pa.int64())], 2)

        return narrow.mapInArrow(run, f"part bigint, conv {kind}, v array<bigint>")

    def distances(part: int, conv: object, kinds: list) -> list:
        only = [tuple(0 if s == to else None for s in range(4)) for to in range(4)]
        return [p for behind in only for p in solve(kinds, behind)[0]]

    chains: list[list[tuple]] = []
    for row in sorted(map(tuple, measured(distances).collect()), key=lambda r: r[0]):
        # The order inside a partition is that of the conversations; two rows of one partition differ in theirs.
        if chains and chains[-1][-1][1] == row[1] and chains[-1][-1][0] != row[0]:
            chains[-1].append(row)
        else:
            chains.append([row])
    chains = [chain for chain in chains if len(chain) > 1]
    behind: dict[tuple[int, object], tuple] = {}
    for chain in chains:
        prices = _LAST
        for part, conv, v in reversed(chain):
            behind[part, conv] = prices
            ways = [[v[4 * to + s] for to in range(4)] for s in range(4)]
            sums = [[a + b for a, b in zip(way, prices, strict=True) if a is not None and b is not None] for way in ways]
            prices = tuple(min(x, default=None) for x in sums)
    if not chains:
        return {}

    def exits(part: int, conv: object, kinds: list) -> list | None:
        if (part, conv) not in behind:
            return None
        prices, steps = solve(kinds, behind[part, conv])
        return [None if p is None else _exit(steps, s) for s, p in enumerate(prices)]

    out_of = {(part, conv): v for part, conv, v in measured(exits).collect()}
    found = {}
    for chain in chains:
        state = START
        for part, conv, _ in chain:
            found[part, conv] = _Part(behind[part, conv], state, part == chain[-1][0])
            state = out_of[part, conv][state]
    return found


# --- results ---------------------------------------------------------------------

_MESSAGE = ["conv_id", "place", "step", "turn", "role", "text", "fault", "edit", "new_role"]


def repair_messages(rows: DataFrame) -> DataFrame:
    """Every message of ``rows`` with the edit that mends its conversation, and the inserted ones.

    ``rows`` has ``conv_id, turn, role, text`` and ``times``, how often a message occurs; other
    columns are not read. Messages stand in the order of turn (NULL first), role and text. The
    result has ``edit`` K(ept), R (another role), D(eleted) or I(nserted), ``new_role`` (NULL where
    deleted) and ``fault``: blank (nothing but ASCII white space), duplicate (role and text stood
    earlier in the conversation) or truncated (does not end in ``.!?``). Blank and duplicate
    messages are deleted. Of all cheapest edits the first in the order of their letters is
    taken. ``place`` and ``step`` give the order.

    A conversation all of whose messages occur 0 times has one row without an edit; a NULL
    conversation is one as any other. An empty table gives an empty result. Roles and texts are
    taken to be filled, see :func:`damage`. A role with an initial other than s, u and a cannot
    be kept.

    Messages are dealt by ranges of the order, so a conversation with a third of all rows lies in
    many partitions, each of which solves its own part; see :func:`_spread`.
    """
    types = dict(rows.dtypes)
    ordered = _ordered(rows)
    parts = _spread(ordered, types["conv_id"])
    arrow = [to_arrow_type(rows.schema[c].dataType) for c in ("conv_id", "turn")]
    kinds = [arrow[0], pa.int64(), pa.int64(), arrow[1], *[pa.string()] * 5]

    def edits(conv: object, held: list[tuple]) -> Iterator[tuple]:
        here = (held[0][-1] >> 33, conv)
        own = parts.get(here, _Part(_LAST, START, True))
        kinds = _kinds([(role, times, fault) for _, role, _, times, fault, _ in held])
        places = [row for row in held for _ in range(row[3])]
        if not places and here not in parts:
            yield (conv, held[0][-1], 0, *[None] * 6)
            return
        if own.last:
            kinds.append(FINISH)
        steps = solve(kinds, (0, None, None, 0) if own.last else own.behind)[1]
        for step, (i, letter, state) in enumerate(trace(steps, own.state)):
            turn, role, text, _, _, place = places[min(i, len(places) - 1)] if places else held[-1]
            if letter == "I":
                yield conv, place, step, None, None, None, None, letter, _ROLE[state]
            else:
                new = role if letter == "K" else _ROLE[state] if letter == "R" else None
                yield conv, place, step, turn, role, text, FAULTS[kinds[i][1]], letter, new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for conv, held in _conversations(batches) for row in edits(conv, held))
        yield from _batches(rows, _MESSAGE, kinds, 512)

    ids = f"conv_id {types['conv_id']}, place bigint, step bigint, turn {types['turn']}"
    texts = "role string, text string, fault string, edit string, new_role string"
    return ordered.select("conv", "turn", "role", "text", "times", "fault", "place").mapInArrow(run, f"{ids}, {texts}")


@dataclass
class _Piece:
    """What some neighbouring messages of a conversation add to its row."""

    place: int = 0
    step: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    first: str | None = None
    last: str | None = None
    messages: int = 0
    audit: list[str] = field(default_factory=list)
    body: list[str] = field(default_factory=list)
    size: int = 0

    def add(self, turn, role, text, fault, edit, new_role) -> None:
        if edit is None:
            return
        if edit != "I":
            self.join_turns(turn, turn, int(turn is not None))
            self.join_roles((role or "")[:1], (role or "")[:1])
            if fault:
                setattr(self, fault, getattr(self, fault) + 1)
        self.cost += {"K": 0, "R": ROLE_COST, "D": DELETE_COST, "I": INSERT_COST}[edit]
        self.cost += TRUNCATED_COST * (fault == "truncated" and edit != "D")
        self.audit.append(edit)
        if new_role is not None:
            self.body.append(f"{new_role}:{text or ''}")
            self.messages += 1
        self.size += 1 + len(text or "")

    def join_turns(self, low, high, turns: int) -> None:
        """Turns come in order, so only the last one can come again."""
        if turns:
            self.turns += turns - (self.high is not None and self.high == low)
            self.low = low if self.low is None else self.low
            self.high = high

    def join_roles(self, first: str | None, last: str | None) -> None:
        if first is not None:
            if self.last is not None:
                self.illegal += self.last + first not in _LEGAL
            else:
                self.first = first
            self.last = last


_PIECE = [
    "place", "step", "blank", "duplicate", "truncated", "illegal", "cost", "low", "high", "turns", "first", "last",
    "messages", "audit", "body",
]
#: Columns of pieces beside those of finished conversations.
_IN_PIECE = [f"piece_{name}" for name in _PIECE]


class _Whole:
    """Puts the pieces of a conversation together; texts go into the checksum as they come."""

    def __init__(self) -> None:
        self.sum = _Piece()
        self.hash = hashlib.sha256()

    def add(self, piece: tuple) -> None:
        own = dict(zip(_PIECE, piece, strict=True))
        total = self.sum
        for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
            setattr(total, name, getattr(total, name) + own[name])
        total.join_turns(own["low"], own["high"], own["turns"])
        total.join_roles(own["first"], own["last"])
        if own["messages"]:
            self.hash.update((("\n" if total.messages else "") + own["body"]).encode("utf-8", "surrogatepass"))
        total.messages += own["messages"]
        total.audit.append(own["audit"])

    def row(self) -> tuple:
        total = self.sum
        gaps = total.high - total.low + 1 - total.turns if total.turns else 0
        counts = (total.blank, total.duplicate, total.truncated, total.illegal, total.cost)
        return (gaps, *counts, "".join(total.audit), self.hash.hexdigest())


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PIECE_KINDS = [*[pa.int64()] * 10, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]


def _pieces(held: Iterator[tuple]) -> Iterator[tuple]:
    """Messages of one conversation as pieces of a bounded size, in the order of :data:`_PIECE`."""

    def closed(piece: _Piece) -> tuple:
        values = [getattr(piece, name) for name in _PIECE[:-2]]
        return (*values, "".join(piece.audit), "\n".join(piece.body))

    piece = None
    for place, step, *message in held:
        piece = piece or _Piece(place, step)
        piece.add(*message)
        if piece.size >= PIECE:
            yield closed(piece)
            piece = None
    if piece:
        yield closed(piece)


def digest_messages(messages: DataFrame) -> DataFrame:
    """One row for each conversation: ``gaps`` in its turns, faults, edits and a checksum of the mended text.

    ``messages`` come from :func:`repair_messages` as they are, in its partitions and their order.
    A conversation inside one partition is finished there. The first and the last of each
    partition may go on elsewhere: their pieces are sorted by conversation and read one after
    the other. The checksum of a text and the string of its edits are single values, so a
    conversation is put together in one task; it holds one piece and the edits at a time.
    """
    kind, arrow = dict(messages.dtypes)["conv_id"], to_arrow_type(messages.schema["conv_id"].dataType)
    texts = ("first", "last", "audit", "body")
    piece_schema = ", ".join(f"piece_{n} {'string' if n in texts else 'bigint'}" for n in _PIECE)
    piece_kinds = [pa.string() if n in texts else pa.int64() for n in _PIECE]
    names = [c.split()[0] for c in _RESULT.split(", ")]
    result_kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last: list[tuple] = []
        for at, (conv, held) in enumerate(_conversations(batches)):
            if last:
                whole = _Whole()
                for piece in last:
                    whole.add(piece[1:])
                yield (last[0][0], True, *whole.row(), *[None] * len(_PIECE))
            last = [(conv, *piece) for piece in _pieces(iter(held))]
            if at == 0:
                yield from ((piece[0], False, *[None] * len(names), *piece[1:]) for piece in last)
                last = []
        yield from ((piece[0], False, *[None] * len(names), *piece[1:]) for piece in last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [arrow, pa.bool_(), *result_kinds, *piece_kinds]
        yield from _batches(rows(batches), ["conv_id", "whole", *names, *_IN_PIECE], kinds, 64)

    both = messages.select(*_MESSAGE).mapInArrow(run, f"conv_id {kind}, whole boolean, {_RESULT}, {piece_schema}")
    path = scratch_path(messages.sparkSession, "conversations")
    both.write.parquet(path)
    both = messages.sparkSession.read.schema(both.schema).parquet(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, whole = None, None
        for batch in batches:
            for own, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole is None or own != conv:
                    if whole is not None:
                        yield (conv, *whole.row())
                    conv, whole = own, _Whole()
                whole.add(tuple(piece))
        if whole is not None:
            yield (conv, *whole.row())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(sums(batches), ["conv_id", *names], [arrow, *result_kinds], 64)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "piece_place", "piece_step")]
    pieces = both.where("NOT whole").select("conv_id", *_IN_PIECE).repartition("conv_id").sortWithinPartitions(*order)
    done = both.where("whole").select("conv_id", *names)
    return done.unionByName(pieces.mapInArrow(together, f"conv_id {kind}, {_RESULT}"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)
              ORDER BY i) AS t
  FROM range(256) r(i)
), keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(range(length(key)), lambda i: ord(key[i + 1])::BIGINT),
                         lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS deal
  FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
         CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN deal = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE deal <> 0
), placed AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 3 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
         chr(10) || role || ':' || text AS own, chr(10) || 'user:' AS u, chr(10) || 'assistant:' AS a
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 3) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 1) AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations),
-- The cheapest edits, least letters first, that lead to each state: nothing yet, system, user, assistant.
paths AS (
  SELECT conv_id, 0::BIGINT AS rn, {'c': 0::BIGINT, 'a': '', 'b': ''} AS s0,
         {'c': 1000000000::BIGINT, 'a': '', 'b': ''} AS s1, {'c': 2::BIGINT, 'a': 'I', 'b': chr(10) || 'user:'} AS s2,
         {'c': 4::BIGINT, 'a': 'II', 'b': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3
  FROM ids
  UNION ALL
  SELECT conv_id, rn, s0, s1, i2, list_sort([s3, {'c': i2.c + 2, 'a': i2.a || 'I', 'b': i2.b || a}])[1]
  FROM (
    SELECT *, list_sort([s2] || [{'c': x.c + 2, 'a': x.a || 'I', 'b': x.b || u} for x in [s0, s1, s3]])[1] AS i2
    FROM (
      SELECT p.conv_id, j.rn, u, a, {'c': s0.c + 3, 'a': s0.a || 'D', 'b': s0.b} AS s0,
             list_sort([{'c': s1.c + 3, 'a': s1.a || 'D', 'b': s1.b}]
               || [{'c': x.c + fault, 'a': x.a || 'K', 'b': x.b || own} for x in [s0] if fault < 2 AND initial = 's'])[1] AS s1,
             list_sort([{'c': s2.c + 3, 'a': s2.a || 'D', 'b': s2.b}]
               || [{'c': x.c + fault, 'a': x.a || 'K', 'b': x.b || own} for x in [s0, s1, s3] if fault < 2 AND initial = 'u']
               || [{'c': x.c + fault + 2, 'a': x.a || 'R', 'b': x.b || u || text} for x in [s0, s1, s3] if fault < 2])[1] AS s2,
             list_sort([{'c': s3.c + 3, 'a': s3.a || 'D', 'b': s3.b}]
               || [{'c': x.c + fault, 'a': x.a || 'K', 'b': x.b || own} for x in [s2] if fault < 2 AND initial = 'a']
               || [{'c': x.c + fault + 2, 'a': x.a || 'R', 'b': x.b || a || text} for x in [s2] if fault < 2])[1] AS s3
      FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.rn = p.rn + 1
    )
  )
), ended AS (
  SELECT conv_id, list_sort([s0, s3])[1] AS best
  FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(substr(best.b, 2)) AS repaired_sha256
FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
