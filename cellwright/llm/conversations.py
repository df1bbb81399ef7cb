"""Conversation repair by a run-length dynamic program over roles and faults.

What the cheapest edits are depends on few things: each row's role, whether it must go and whether its end is cut off.
Those symbols are sorted by conversation and turn across all tasks and stored in pieces of bounded length; equal symbols in
a row are one run. A symbol is a small matrix of costs between the states of the role grammar (least costs add up along
the rows), a run is a power of it, put together from cached binary powers, and a piece is the product of its runs. Costs
to the end are carried back over pieces; each piece then unrolls its choices on its own. Long conversations are spread over
tasks that way. Texts are moved once, to be hashed in order: the hash of a conversation is one pass by its definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import cut, in_tasks, table
from cellwright.operators.order import sorted_splits

#: Rows of a conversation that are worked out together.
PIECE = 32_768
#: Rows that a task gives out at a time.
ROWS_OUT = 5_000
# What counts as blank, and what ends a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, INSERT, DELETE, CUT_OFF = 0, 2, 2, 3, 1

#: States of the grammar by the role given out last: none, system, user, assistant. A row out of order continues to NEXT.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEVER = 1 << 58
#: Costs to the end of a conversation after its last row: a started pair is completed.
AT_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: The symbol of a row that has to go.
GONE = ("", False)


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two cost matrices, or of a matrix and a vector, in which sums are products and minima are sums."""
    if b.ndim == 1:
        return np.minimum((a + b).min(axis=1), NEVER)
    return np.minimum((a[:, :, None] + b).min(axis=1), NEVER)


@cache
def _inserts() -> np.ndarray:
    costs = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        costs[state, NEXT[state]] = INSERT
        costs[state, NEXT[NEXT[state]]] = min(costs[state, NEXT[NEXT[state]]], 2 * INSERT)
        costs[state, state] = 0
    return costs


@cache
def power(symbol: tuple[str, bool], bit: int) -> np.ndarray:
    """The costs from state to state over 2^bit rows of a symbol (initial of the role, cut off)."""
    if bit:
        half = power(symbol, bit - 1)
        return crossed(half, half)
    costs = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(costs, DELETE)
    if symbol != GONE:
        extra = CUT_OFF if symbol[1] else 0
        for state in range(4):
            costs[state, NEXT[state]] = min(costs[state, NEXT[state]], REROLE + extra)
            if state in _STEP.get(symbol[0], {}):
                after = _STEP[symbol[0]][state]
                costs[state, after] = min(costs[state, after], KEEP + extra)
    return crossed(_inserts(), costs)


def over_run(symbol: tuple[str, bool], length: int, after: np.ndarray) -> np.ndarray:
    """What is before a run of a symbol, from what is after it (a vector of costs to the end, or a matrix)."""
    bit = 0
    while length:
        if length & 1:
            after = crossed(power(symbol, bit), after)
        length, bit = length >> 1, bit + 1
    return after


def runs(symbols: list[tuple[str, bool]], copies: list[int]) -> list[tuple[tuple[str, bool], int]]:
    """Equal symbols in a row as (symbol, length). All copies of a row but the first must go."""
    out: list[tuple[tuple[str, bool], int]] = []
    for symbol, n in zip(symbols, copies):
        for s, k in ((symbol, 1), (GONE, n - 1)):
            if out and out[-1][0] == s:
                out[-1] = (s, out[-1][1] + k)
            elif k:
                out.append((s, k))
    return out


def unrolled(symbols: list[tuple[str, bool]], copies: list[int], state: int, to_end: np.ndarray, last: bool) -> tuple[list[str], int, int]:
    """The edits of every row (with inserts before it), the state after them, and their cost.

    Of the edits that keep the cost least, the smallest letter is taken each time: D, I, K, R. A row's further copies
    are deleted; the letters hold the first copy's only. After the last row of a conversation come inserts, if any.
    """
    at_runs = [to_end]
    found = runs(symbols, copies)
    for symbol, length in reversed(found):
        at_runs.append(over_run(symbol, length, at_runs[-1]))
    at_runs.reverse()
    run, left, inside, total = 0, 0, [], 0
    letters: list[str] = []

    def step() -> tuple[np.ndarray, np.ndarray]:
        """Costs to the end before and after the next row."""
        nonlocal run, left, inside
        if not left:
            symbol, left = found[run]
            inside = [at_runs[run + 1]]
            for _ in range(left):
                inside.append(over_run(symbol, 1, inside[-1]))
            run += 1
        left -= 1
        before = inside.pop()
        return before, inside[-1]

    for symbol, n in zip(symbols, copies):
        edits = ""
        if symbol == GONE:
            # Rows that must go never change the state, and D comes before any insert.
            edits, total = "D", total + DELETE
        else:
            before, after = step()
            extra = CUT_OFF if symbol[1] else 0
            kept = _STEP.get(symbol[0], {})
            while not edits or edits[-1] == "I":
                least = before[state]
                if DELETE + after[state] == least:
                    edits, total = edits + "D", total + DELETE
                elif INSERT + before[NEXT[state]] == least:
                    edits, total, state = edits + "I", total + INSERT, NEXT[state]
                elif state in kept and extra + after[kept[state]] == least:
                    edits, total, state = edits + "K", total + extra, kept[state]
                else:
                    edits, total, state = edits + "R", total + REROLE + extra, NEXT[state]
        total += DELETE * (n - 1)
        letters.append(edits)
        gone = n - 1 + (symbol == GONE)
        # Skip what of the run of deletions this row takes.
        while gone:
            if not left:
                run, left, inside = run + 1, found[run][1], []
            taken = min(gone, left)
            left, gone = left - taken, gone - taken
    if last:
        while AT_END[state]:
            letters[-1] += "I"
            state, total = NEXT[state], total + INSERT
    return letters, state, total


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held.clear()
    if held:
        yield made()


# A piece: where it begins, its rows, what it counts, and its costs from state to state.
_PIECE = "conv_id long, split int, place long, turns array<long>, roles array<string>, digests array<binary>, copies array<long>, symbols array<string>, counts array<long>, ends array<string>, costs array<long>"
_PIECE_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("split", pa.int32()), ("place", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
     ("digests", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64())), ("symbols", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
     ("ends", pa.list_(pa.string())), ("costs", pa.list_(pa.int64()))]
)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _symbols(written: list[str]) -> list[tuple[str, bool]]:
    """A row's symbol is written as its initial, with + where its end is cut off, and as nothing where it must go."""
    return [(w[0], w.endswith("+")) if w else GONE for w in written]


def _pieces(size: int):
    def piece(rows: list[tuple]) -> tuple:
        conv_id, _, _, _, _, _, _, split, place, _ = rows[0]
        symbols, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        previous = None
        for _, _, _, _, n, flaw, initial, _, _, is_first in rows:
            if flaw == "blank":
                counts["blank"] += n
            else:
                counts["duplicate"] += n - is_first
                counts["truncated"] += is_first and flaw == "truncated"
            # The mark in front keeps initials that are no letter of the grammar, or missing, apart from rows that must go.
            symbols.append("" if flaw == "blank" or not is_first else (initial if initial in _STEP else "?") + "+" * (flaw == "truncated"))
            counts["illegal"] += n - 1 + (previous is not None and (previous, initial) not in LEGAL)
            previous = initial
        turns = [row[1] for row in rows]
        known = [t for t in turns if t is not None]
        distinct = sum(a != b for a, b in zip(known, known[1:])) + bool(known)
        copies = [row[4] for row in rows]
        costs = np.where(np.eye(4, dtype=bool), 0, NEVER)
        for symbol, length in reversed(runs(_symbols(symbols), copies)):
            costs = over_run(symbol, length, costs)
        numbers = [*counts.values(), known[0] if known else None, known[-1] if known else None, distinct]
        ends = [rows[0][6], rows[-1][6]]
        return conv_id, split, place, turns, [r[2] for r in rows], [r[3] for r in rows], copies, symbols, numbers, ends, costs.reshape(-1).tolist()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for row in _rows(batches):
            if held and (row[0] != held[0][0] or row[7] != held[0][7] or row[8] != held[-1][8] + 1 or len(held) >= size):
                yield piece(held)
                held = []
            held.append(row)
        if held:
            yield piece(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(found(batches), _PIECE_ARROW, 500)

    return run


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted backwards within conversations: costs to the end after each piece, and whether it is the first or last."""

    def found() -> Iterator[tuple]:
        before: tuple | None = None
        vector = AT_END
        for conv_id, split, place, costs in _rows(batches):
            same = before is not None and before[0] == conv_id
            if before is not None:
                yield (*before[1:], not same)
            if not same:
                vector = AT_END
            before = (conv_id, split, place, vector.tolist(), not same)
            vector = crossed(np.array(costs, np.int64).reshape(4, 4), vector)
        if before is not None:
            yield (*before[1:], True)

    schema = pa.schema([("s", pa.int32()), ("p", pa.int64()), ("to_end", pa.list_(pa.int64())), ("last", pa.bool_()), ("first", pa.bool_())])
    yield from _batches(found(), schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece's edits; those of a piece that is not the first of its conversation for each state it may begin in."""

    def found() -> Iterator[tuple]:
        for conv_id, split, place, copies, written, to_end, last, first in _rows(batches):
            vector, symbols = np.array(to_end, np.int64), _symbols(written)
            for start in (0,) if first else range(4):
                letters, end, cost = unrolled(symbols, copies, start, vector, last)
                yield conv_id, split, place, first and last, start, end, cost, letters

    schema = pa.schema(
        [("conv_id", pa.int64()), ("split", pa.int32()), ("place", pa.int64()), ("lone", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("letters", pa.list_(pa.string()))]
    )
    yield from _batches(found(), schema, 500)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted pieces with every state they may begin in: the state each does begin in."""

    def found() -> Iterator[tuple]:
        conversation, state, at = None, 0, None
        for conv_id, split, place, start, end in _rows(batches):
            if conversation is None or conversation[0] != conv_id:
                conversation, state, at = (conv_id,), 0, None
            if at != (split, place) and start == state:
                at = (split, place)
                yield split, place, start
                state = end

    schema = pa.schema([("s", pa.int32()), ("p", pa.int64()), ("b", pa.int32())])
    yield from _batches(found(), schema)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_ARROW = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Repair:
    """One conversation while its pieces, edits and texts pass by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.audit, self.hash, self.empty = conv_id, 0, [], hashlib.sha256(), True
        self.counts, self.cost, self.first, self.last, self.distinct, self.initial = [0, 0, 0, 0], 0, None, None, 0, None
        self.waiting: tuple | None = None

    def piece(self, numbers: list[int | None], ends: list[str], cost: int) -> None:
        self.counts = [a + b for a, b in zip(self.counts, numbers)]
        first, last, distinct = numbers[4:]
        if distinct:
            self.distinct += distinct - (self.last == first)
            self.first, self.last = first if self.first is None else self.first, last
        self.counts[3] += self.initial is not None and (self.initial, ends[0]) not in LEGAL
        self.initial, self.cost = ends[1], self.cost + cost

    def line(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + role.encode() + b":" + text.encode())
        self.empty = False

    def edits(self, letters: str, copies: int, turn: int | None, role: str, digest: bytes) -> None:
        """Take a row's edits. Its own line, if it stays, waits for its text."""
        self.waiting = None
        head = letters.rstrip("I")
        for letter in head[:-1]:
            self._insert()
        own = head[-1]
        if own == "K":
            self.state = _STEP[role[0]][self.state]
            self.waiting = (turn, role, digest, role, letters[len(head) :])
        elif own == "R":
            self.state = NEXT[self.state]
            self.waiting = (turn, role, digest, NAMES[self.state], letters[len(head) :])
        else:
            for _ in letters[len(head) :]:
                self._insert()
        self.audit.append(head + "D" * (copies - 1) + letters[len(head) :])

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self.line(NAMES[self.state], "")

    def text(self, turn: int | None, role: str, digest: bytes, text: str) -> None:
        if self.waiting and self.waiting[:3] == (turn, role, digest):
            self.line(self.waiting[3], text)
            trailing, self.waiting = self.waiting[4], None
            for _ in trailing:
                self._insert()

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, *self.counts, self.cost, "".join(self.audit), self.hash.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what is known of each conversation, in order, its row of the result. A task holds one text at a time."""

    def found() -> Iterator[tuple]:
        now: _Repair | None = None
        for conv_id, kind, numbers, ends, cost, turn, role, digest, letters, copies, text in _rows(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.row()
                now = _Repair(conv_id)
            if kind == 1:
                now.piece(numbers, ends, cost)
            elif kind == 2:
                now.edits(letters, copies, turn, role, digest)
            elif kind == 3:
                now.text(turn, role, digest, text)
        if now is not None:
            yield now.row()

    yield from _batches(found(), _RESULT_ARROW)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, n (2 for a row that is repeated). NULL roles and texts are one blank."""
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(named.cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        kind.alias("kind"),
    ).where("kind != 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def repair(rows: DataFrame, conversations: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """One row per conv_id of ``conversations``: faults of its rows, the cheapest repair's cost and audit, and its hash.

    ``rows`` has conv_id, turn, role, text (no NULL roles or texts) and n, how often the row stands there. Rows are taken by
    turn, NULL turns first; rows of one turn by role, then by the SHA-256 of the text. Rows that agree in all of these follow each
    other. A NULL conv_id is a conversation like any other. Conversations without rows have zeros, an empty audit and the hash of
    nothing. Roles that begin with neither s, u nor a cannot be kept. Blank rows are those without any other character than
    blanks; an empty role has no initial, so its pairs are illegal. Empty tables give an empty result; other columns are not looked at.
    """
    ended = F.rtrim("text", F.lit(BLANKS))
    flaw = F.when(ended == "", "blank").when(~F.substring(ended, -1, 1).isin(*ENDS), "truncated").otherwise("none")
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "n", flaw.alias("flaw"), "text")
    # Equal rows are one; the texts themselves stay where they are until they are hashed.
    light = texts.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.max("flaw").alias("flaw"))
    light = light.withColumn("initial", F.substring("role", 1, 1))
    firsts = texts.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t"))
    firsts = firsts.select(F.col("conv_id").alias("c1"), F.col("t.turn").alias("t1"), F.col("role").alias("r1"), F.col("digest").alias("d1"), F.lit(1).cast("long").alias("hit"))
    # A row meets its text's first place only if it stands there, so no key has more than one row on either side.
    met = light.join(firsts, _same("conv_id", "c1") & _same("turn", "t1") & (F.col("role") == F.col("r1")) & (F.col("digest") == F.col("d1")), "left")
    marked = met.select("conv_id", "turn", "role", "digest", "n", "flaw", "initial", F.coalesce("hit", F.lit(0).cast("long")).alias("is_first"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    ordered = sorted_splits(marked, order).select("conv_id", "turn", "role", "digest", "n", "flaw", "initial", "_split", "_place", "is_first")
    pieces = cut(in_tasks(ordered, _pieces(piece_rows), _PIECE), "pieces")
    backwards = pieces.select("conv_id", "split", "place", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("split"), F.desc("place"))
    carried = in_tasks(backwards, _carried, "s int, p long, to_end array<long>, last boolean, first boolean")
    known = pieces.join(carried, (F.col("split") == F.col("s")) & (F.col("place") == F.col("p")))
    edits = in_tasks(
        known.select("conv_id", "split", "place", "copies", "symbols", "to_end", "last", "first"),
        _edited,
        "conv_id long, split int, place long, lone boolean, start int, end int, cost long, letters array<string>",
    )
    edits = cut(edits, "edits")
    parts = edits.where("NOT lone").select("conv_id", "split", "place", "start", "end").repartition("conv_id").sortWithinPartitions("conv_id", "split", "place", "start")
    chosen = in_tasks(parts, _chosen, "s int, p long, b int")
    several = edits.where("NOT lone").join(chosen, (F.col("split") == F.col("s")) & (F.col("place") == F.col("p")) & (F.col("start") == F.col("b")), "left_semi")
    edits = edits.where("lone").unionByName(several).select(F.col("split").alias("s"), F.col("place").alias("p"), "cost", "letters")
    pieces = cut(pieces.join(edits, (F.col("split") == F.col("s")) & (F.col("place") == F.col("p"))).drop("s", "p", "symbols", "costs"), "chosen")

    def told(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
        types = {"split": "int", "place": "long", "counts": "array<long>", "ends": "array<string>", "cost": "long", "turn": "long", "role": "string", "digest": "binary", "letters": "string", "n": "long", "text": "string"}
        return df.select("conv_id", F.lit(kind).alias("kind"), *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])

    whole = {n: F.col(n) for n in ("split", "place", "counts", "ends", "cost")}
    zipped = pieces.select("conv_id", F.explode(F.arrays_zip("turns", "roles", "digests", "copies", "letters")).alias("e"))
    of_row = dict(turn=F.col("e.turns"), role=F.col("e.roles"), digest=F.col("e.digests"), n=F.col("e.copies"), letters=F.col("e.letters"))
    all_told = (
        told(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), 0)
        .union(told(pieces, 1, **whole))
        .union(told(zipped, 2, **of_row))
        .union(told(texts.where("flaw != 'blank'"), 3, turn=F.col("turn"), role=F.col("role"), digest=F.col("digest"), text=F.col("text")))
    )
    all_told = all_told.repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 1, "split", "place", "turn", "role", "digest", "kind")
    return in_tasks(all_told.select("conv_id", "kind", "counts", "ends", "cost", "turn", "role", "digest", "letters", "n", "text"), _repaired, _RESULT)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


# The same by a plain recursion: from the last row back, the least (cost, audit) and its lines for each of the four states.
# Cyclic redundancy codes and their table are worked out with lists.
def _sql() -> str:
    states, lines = (0, 1, 2, 3), {2: "'user:' || chr(10)", 3: "'assistant:' || chr(10)"}

    def then(state: int, cost: str, letter: str, line: str) -> str:
        return f"{{'c': s{state}.c + {cost}, 'a': '{letter}' || s{state}.a, 'r': {line} || s{state}.r}}"

    def inserted(source: str, state: int) -> str:
        return f"{{'c': {source}{NEXT[state]}.c + 2, 'a': 'I' || {source}{NEXT[state]}.a, 'r': {lines[NEXT[state]]} || {source}{NEXT[state]}.r}}"

    def bare(state: int) -> str:
        options = [then(state, "3", "D", "''")]
        name = NAMES[NEXT[state]]
        options.append(f"CASE WHEN NOT gone THEN {then(NEXT[state], '2 + cut_off', 'R', f"'{name}:' || text || chr(10)")} END")
        for initial, steps in _STEP.items():
            if state in steps:
                options.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {then(steps[state], 'cut_off', 'K', "role || ':' || text || chr(10)")} END")
        return f"list_min([{', '.join(options)}]) AS b{state}"

    bares = ", ".join(bare(s) for s in states)
    ones = ", ".join(f"list_min([b{s}, {inserted('b', s)}]) AS i{s}" for s in states)
    twos = ", ".join(f"list_min([i{s}, {inserted('i', s)}]) AS s{s}" for s in states)
    end = ["{'c': 0::BIGINT, 'a': '', 'r': ''}", "{'c': 4::BIGINT, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}", "{'c': 2::BIGINT, 'a': 'I', 'r': 'assistant:' || chr(10)}"]
    ends = ", ".join(f"{end[k]} AS s{s}" for s, k in zip(states, (0, 1, 2, 0)))
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295],
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
dealt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k
  FROM coded, range(2) copies(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {blanks}) AS ended,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), k) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) > 1 AS again
  FROM dealt),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous
  FROM judged),
flagged AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut_off FROM faults),
back AS (
  SELECT conv_id, max(i) AS i, {ends} FROM flagged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, s3 FROM (
    SELECT conv_id, i, {twos} FROM (
      SELECT conv_id, i, {ones} FROM (
        SELECT b.conv_id, b.i - 1 AS i, {bares}
        FROM back b JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i)))),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank')::BIGINT AS blank,
    count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM flagged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
  sha256(CASE WHEN length(coalesce(s0.r, '')) = 0 THEN '' ELSE left(s0.r, length(s0.r) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM back WHERE i = 0) b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES = {"op13_conversations": op13_conversations}
ORACLE = {"op13_conversations": _sql()}
