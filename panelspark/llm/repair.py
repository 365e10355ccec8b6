"""Conversation structure repair: cheapest edits by Four-Russians block tables.

A conversation is a sequence of symbols, one per row, and the cost still to pay from each of four
grammar states is a vector. Vectors less their minimum are few, so what a block of symbols
does to each of them is tabulated once; long conversations are cut into segments that tasks share.
"""

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch, map_arrow

BLOCK = 3
# Rows of a conversation that one segment holds at most.
SEGMENT_ROWS = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_EDITS = 200_000  # traced blocks that a worker remembers
# States by what the repaired roles end in: nothing yet, s, u, a. The first and the last may end a conversation.
STATES = 4
_NEXT_ROLE = ("u", "u", "a", "u")
_AFTER = {"u": 2, "a": 3}
_FROM = {"s": (0,), "u": (0, 1, 3), "a": (2,), "o": ()}
_NAMES = {"u": "user", "a": "assistant"}
# Symbol of a row: twice the index of its role's initial, plus one if truncated; the last one must be deleted.
INITIALS = "suao"
MUST_DELETE = 2 * len(INITIALS)
SYMBOLS = MUST_DELETE + 1
_SPACES = " \t\n\x0b\x0c\r"


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(edit, cost, next state)`` of what may become of a row, in ASCII order of the edits."""
    moves = [("D", DELETE, state)]
    if symbol < MUST_DELETE:
        initial, more = INITIALS[symbol // 2], TRUNCATED * (symbol % 2)
        if state in _FROM[initial]:
            moves.append(("K", KEEP + more, 1 if initial == "s" else _AFTER[initial]))
        moves.append(("R", REROLE + more, _AFTER[_NEXT_ROLE[state]]))
    return moves


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """The costs from each state if rows may be inserted first; two in a row are worth it at most."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_AFTER[_NEXT_ROLE[s]]]) for s, c in enumerate(costs)]
    return tuple(costs)


END = _with_inserts([0, 1 << 20, 1 << 20, 0])


def _before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """The costs from each state before a row, given those after it."""
    return _with_inserts([min(c + costs[to] for _, c, to in _moves(symbol, s)) for s in range(STATES)])


def _normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(c - low for c in costs), low


class Tables:
    """The normalised vectors that occur, and what every block of 1 to ``BLOCK`` symbols turns each of them into."""

    def __init__(self):
        self.vectors = [_normal(END)[0]]
        self.number = {self.vectors[0]: 0}
        step: list[list[tuple[int, int]]] = []
        while len(step) < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                vector, low = _normal(_before(symbol, self.vectors[len(step)]))
                if vector not in self.number:
                    self.number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((self.number[vector], low))
            step.append(row)
        one = np.array(step).transpose(2, 1, 0)  # (vector or cost, symbol, vector after)
        self.following, self.added = {1: one[0]}, {1: one[1]}
        for k in range(2, BLOCK + 1):
            nexts, costs = [], []
            for block in product(range(SYMBOLS), repeat=k):
                rest = self._code(block[1:])
                after, cost = self.following[k - 1][rest], self.added[k - 1][rest]
                nexts.append(one[0][block[0]][after])
                costs.append(cost + one[1][block[0]][after])
            self.following[k], self.added[k] = np.array(nexts), np.array(costs)

    @staticmethod
    def _code(block) -> int:
        code = 0
        for symbol in block:
            code = code * SYMBOLS + symbol
        return code

    def through(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector after the symbols: the one before them, and what the minimum grows by."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for block in _blocks(symbols)[::-1]:
            code, k = self._code(block), len(block)
            cost = cost + self.added[k][code][at]
            at = self.following[k][code][at]
        return at, cost

    def borders(self, symbols: bytes, after: int) -> list[int]:
        """The vector after each block, given the one after the last."""
        out = [after]
        for block in _blocks(symbols)[:0:-1]:
            out.append(int(self.following[len(block)][self._code(block)][out[-1]]))
        return out[::-1]


@cache
def tables() -> Tables:
    return Tables()


def _blocks(symbols: bytes) -> list[bytes]:
    return [symbols[i : i + BLOCK] for i in range(0, len(symbols), BLOCK)]


def _inserts(state: int, costs: tuple[int, ...]) -> bool:
    return costs[state] == INSERT + costs[_AFTER[_NEXT_ROLE[state]]]


@lru_cache(_EDITS)
def _expand(block: bytes, after: int, state: int) -> tuple[str, int]:
    """The edits of a block, least in ASCII of the cheapest ones, from a state; and the state they lead to.

    The vectors within the block come from the one after it, backward; the edits are then picked forward.
    """
    vectors = [tables().vectors[after]]
    for symbol in reversed(block):
        vectors.append(_before(symbol, vectors[-1]))
    vectors.reverse()
    edits = []
    for i, symbol in enumerate(block):
        while True:
            options = [(e, to) for e, c, to in _moves(symbol, state) if c + vectors[i + 1][to] == vectors[i][state]]
            if _inserts(state, vectors[i]):
                options.append(("I", _AFTER[_NEXT_ROLE[state]]))
            edit, state = min(options)
            edits.append(edit)
            if edit != "I":
                break
    return "".join(edits), state


def trace(symbols: bytes, after: int, state: int, last: bool) -> tuple[str, int]:
    """The edits of a segment from a state, block by block, and the state they lead to; the last one also ends the conversation."""
    edits = []
    for block, border in zip(_blocks(symbols), tables().borders(symbols, after)) if symbols else ():
        some, state = _expand(block, border, state)
        edits.append(some)
    while last and END[state]:
        edits.append("I")
        state = _AFTER[_NEXT_ROLE[state]]
    return "".join(edits), state


def repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines ``role:text`` that the edits make of a segment's rows, from a state."""
    lines, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        role = _NEXT_ROLE[state]
        if edit == "K":
            lines.append(f"{roles[at]}:{texts[at]}")
            state = 1 if roles[at][:1] == "s" else _AFTER[roles[at][:1]]
        else:
            lines.append(f"{_NAMES[role]}:{texts[at] if edit == 'R' else ''}")
            state = _AFTER[role]
        at += edit != "I"
    return lines


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after faults that the checksum of ``conv_id:turn`` decides.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 takes the marks ``.!?`` out, 3 repeats the row (``copy`` 1) and
    4 makes its role user. NULLs of role and text, and in the checksum's text, count as one space.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("_kind"),
    ).filter("_kind <> 0").withColumn("copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind")


def _ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, nul, seg, id, turn, role, text`` as a table: rows dealt into sorted ranges and numbered in order.

    A range is a task's; a conversation of any size spreads over as many as it takes, as the last
    sort key tells equal rows, which are interchangeable, apart. A segment is a stretch of one conversation in one range.
    """
    keyed = rows.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().cast("int").alias("nul"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["nul", "conv", F.col("turn").asc_nulls_first(), "role", "_digest", "_row"]
    ranged = keyed.withColumn("_digest", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select("conv", "nul", F.monotonically_increasing_id().alias("id"), "turn", "role", "text")
    return scratch.table(numbered, "ordered")


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows with their first fault: blank, duplicate or truncated."""
    # The first of equal rows has an id of its own, so no join key is hot, however often a row repeats.
    text = F.sha2(F.concat("role", F.lit("\x00"), "text"), 256)
    firsts = rows.groupBy("nul", "conv", text.alias("_text")).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    trimmed = F.rtrim("text", F.lit(_SPACES))
    blank = trimmed == ""
    cut = ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "b").when(F.col("first").isNull(), "d").when(cut, "t")
    return rows.join(firsts, "id", "left").withColumn("fault", F.coalesce(fault, F.lit(""))).drop("first")


def _segments(rows: DataFrame) -> DataFrame:
    """Per segment its rows' symbols, roles, texts and counts; a segment has ``SEGMENT_ROWS`` rows at most."""
    initial = F.substring("role", 1, 1)
    index = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bad = F.col("fault").isin("b", "d")
    symbol = F.when(bad, MUST_DELETE).otherwise(index * 2 + (F.col("fault") == "t").cast("int"))
    # Ranges start their ids anew at multiples of 2**33, so a segment lies within one range.
    dealt = rows.withColumns({"seg": F.expr(f"id div {SEGMENT_ROWS}"), "symbol": symbol})
    listed = dealt.groupBy("nul", "conv", "seg").agg(
        F.array_sort(F.collect_list(F.struct("id", "symbol", "role", "text"))).alias("rows"),
        *[F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
    )
    first, last = F.get("rows", F.lit(0))["role"], F.element_at("rows", -1)["role"]
    return listed.select(
        "nul", "conv", "seg", "blank", "duplicate", "truncated",
        F.transform("rows", lambda r: r["symbol"]).alias("symbols"),
        F.transform("rows", lambda r: r["role"]).alias("roles"),
        F.transform("rows", lambda r: r["text"]).alias("texts"),
        F.substring(first, 1, 1).alias("first"),
        F.substring(last, 1, 1).alias("last"),
    )


def _symbols(batch: pa.RecordBatch) -> list[bytes]:
    return [bytes(x) for x in batch.column("symbols").to_pylist()]


_LEGAL = {"su", "ua", "au"}


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each segment does to every vector, and its adjacent roles that may not follow each other."""
    for batch in batches:
        before, cost, illegal = [], [], []
        for symbols, roles in zip(_symbols(batch), batch.column("roles").to_pylist()):
            at, more = tables().through(symbols)
            before.append(at.tolist())
            cost.append(more.tolist())
            illegal.append(sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:])))
        kept = [c for c in batch.schema.names if c not in ("symbols", "roles")]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, kept), pa.array(before, pa.list_(pa.int32())), pa.array(cost, pa.list_(pa.int64())), pa.array(illegal, pa.int64())],
            names=[*kept, "before", "cost", "illegal"],
        )


def _rows(batch: pa.RecordBatch, *columns: str) -> zip:
    return zip(*(batch.column(c).to_pylist() for c in columns))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted from each conversation's last to its first: the vector after each, and the cost from its start on."""
    current, at, cost = None, 0, 0
    for batch in batches:
        after, ends, total = [], [], []
        for nul, conv, before, more in _rows(batch, "nul", "conv", "before", "cost"):
            if (nul, conv) != current:
                current, at, cost = (nul, conv), 0, 0
                ends.append(True)
            else:
                ends.append(False)
            after.append(at)
            cost += more[at]
            at = before[at]
            total.append(cost + tables().vectors[at][0])
        kept = [c for c in batch.schema.names if c not in ("before", "cost")]
        columns = [*map(batch.column, kept), pa.array(after, pa.int32()), pa.array(ends), pa.array(total, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "after", "ends", "total"])


def _leads_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each segment for every state before it."""
    for batch in batches:
        exits = []
        for symbols, after, ends in zip(_symbols(batch), batch.column("after").to_pylist(), batch.column("ends").to_pylist()):
            exits.append([trace(symbols, after, s, ends)[1] for s in range(STATES)])
        kept = ["nul", "conv", "seg"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(exits, pa.list_(pa.int32()))], names=[*kept, "exits"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted from each conversation's first to its last: the state before each."""
    current, state = None, 0
    for batch in batches:
        states = []
        for nul, conv, exits in _rows(batch, "nul", "conv", "exits"):
            if (nul, conv) != current:
                current, state = (nul, conv), 0
            states.append(state)
            state = exits[state]
        kept = ["nul", "conv", "seg"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(states, pa.int32())], names=[*kept, "state"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each segment and the lines they make."""
    for batch in batches:
        edits, lines = [], []
        rows = _rows(batch, "after", "ends", "state", "roles", "texts")
        for symbols, (after, ends, state, roles, texts) in zip(_symbols(batch), rows):
            some, _ = trace(symbols, after, state, ends)
            edits.append(some)
            lines.append(repaired(some, state, roles, texts))
        kept = ["nul", "conv", "seg"]
        columns = [*map(batch.column, kept), pa.array(edits, pa.string()), pa.array(lines, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "edits", "lines"])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _per_conversation(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], schema: pa.Schema, begin, add, end) -> Iterator[pa.RecordBatch]:
    """Fold the sorted segments of each conversation into a row, a batch of rows at a time."""
    current, state, done = None, None, []
    for batch in batches:
        for nul, conv, *values in _rows(batch, "nul", "conv", *columns):
            if (nul, conv) != current:
                if current is not None:
                    done.append((*current, *end(state)))
                current, state = (nul, conv), begin()
            add(state, *values)
        if len(done) >= 1000:
            yield _batch(done, schema)
            done = []
    if current is not None:
        done.append((*current, *end(state)))
    yield _batch(done, schema)


_KEYS = [("nul", pa.int32()), ("conv", pa.int64())]


class _Digest:
    """The edits of a conversation so far, and the digest of its lines."""

    def __init__(self):
        self.edits, self.sha, self.any_line = [], hashlib.sha256(), False

    def add(self, edits: str, text: str | None) -> None:
        self.edits.append(edits)
        if text is not None:  # a segment without a line adds no line break
            self.sha.update((("\n" if self.any_line else "") + text).encode())
            self.any_line = True

    def end(self) -> tuple:
        return "".join(self.edits), self.sha.hexdigest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted segments: each conversation's edits, and the digest of its lines, carried from segment to segment."""
    schema = pa.schema([*_KEYS, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return _per_conversation(batches, ("edits", "text"), schema, _Digest, _Digest.add, _Digest.end)


class _Counts:
    """A conversation's faults so far, with what meets at the borders of its segments; its cost is the first segment's."""

    def __init__(self):
        self.counts, self.cost, self.last = [0, 0, 0, 0], None, None

    def add(self, first: str, last: str, total: int, *more: int) -> None:
        if self.cost is None:
            self.cost = total
        else:
            self.counts[-1] += self.last + first not in _LEGAL
        self.counts = [a + b for a, b in zip(self.counts, more)]
        self.last = last

    def end(self) -> tuple:
        return *self.counts, self.cost


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted segments: each conversation's counts and cost."""
    names = ("blank", "duplicate", "truncated", "illegal")
    schema = pa.schema([*_KEYS, *((n, pa.int64()) for n in (*names, "cost"))])
    return _per_conversation(batches, ("first", "last", "total", *names), schema, _Counts, _Counts.add, _Counts.end)


def _scan(rows: DataFrame, task, schema: str, descending: bool = False) -> DataFrame:
    """Run a task over the segments of each conversation in order; a row per segment is all it reads of it."""
    seg = F.col("seg").desc() if descending else F.col("seg")
    return map_arrow(rows.repartition("nul", "conv").sortWithinPartitions("nul", "conv", seg), task, schema)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Find each conversation's faults and the cheapest edits that give it the structure ``(s?(ua)+)?``.

    ``rows`` has ``conv_id, turn, role, text``; further columns are ignored. Returns a table of segments,
    ``conv_id, seg, edits, lines`` with the repaired lines ``role:text``, and a table of conversations, ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256``, for every conv_id of ``ids``, by default ``rows`` (NULL is one).
    A conv_id without rows has zeros, no edits and the digest of an empty string; an empty table gives no rows.

    Rows go by turn, NULL turns first; rows of one turn by role and the MD5 of their text. NULL roles and texts count as one
    space. A row's first fault counts: blank, duplicate of an earlier row, truncated. Keep costs
    0, rerole 2, delete 3 (a must for blank rows and duplicates), insert 2, and a truncated row
    that stays 1 more. Of the cheapest edits those least in ASCII are taken.

    1. Rows are sorted in ranges and cut into segments, so a conversation of any size is shared by tasks.
    2. Each segment's effect on every normalised cost vector is looked up block by block.
    3. A scan over segments, last to first, gives the vector after each, and the cost.
    4. Each segment is expanded from that vector; a scan over states, first to last, picks its edits.
    5. The digest is carried over a conversation's segments in order, as a digest must be.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    ordered = _ordered(rows, scratch)
    turns = ordered.groupBy("nul", "conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    segments = scratch.table(_segments(_flagged(ordered)), "segments")
    counts = "blank bigint, duplicate bigint, truncated bigint, first string, last string"
    key = "nul int, conv bigint, seg bigint"
    narrow = segments.select("nul", "conv", "seg", "blank", "duplicate", "truncated", "first", "last", "symbols", "roles")
    effects = map_arrow(narrow, _through, f"{key}, {counts}, before array<int>, cost array<bigint>, illegal bigint")
    known = scratch.table(
        _scan(effects, _backward, f"{key}, {counts}, illegal bigint, after int, ends boolean, total bigint", descending=True), "vectors"
    )
    narrow = known.select("nul", "conv", "seg", "after", "ends")
    placed = segments.select("nul", "conv", "seg", "symbols").join(narrow, ["nul", "conv", "seg"])
    states = _scan(map_arrow(placed, _leads_to, f"{key}, exits array<int>"), _forward, f"{key}, state int")
    whole = segments.select("nul", "conv", "seg", "symbols", "roles", "texts").join(narrow, ["nul", "conv", "seg"]).join(states, ["nul", "conv", "seg"])
    written = scratch.table(map_arrow(whole, _written, f"{key}, edits string, lines array<string>"), "edits")
    joined = F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("text")
    digests = _scan(written.select("nul", "conv", "seg", "edits", joined), _digested, "nul int, conv bigint, audit string, repaired_sha256 string")
    sums = _scan(known, _summed, "nul int, conv bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint")
    keys = (rows if ids is None else ids).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    keys = keys.select("conv_id", F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().cast("int").alias("nul"))
    found = keys
    for table in (turns, sums, digests):
        found = found.join(table, ["nul", "conv"], "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    whole = found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), nothing.alias("repaired_sha256"))
    return written.select(F.when(F.col("nul") == 0, F.col("conv")).alias("conv_id"), "seg", "edits", "lines"), whole

