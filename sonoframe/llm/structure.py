"""Repair of the order of turns in conversations, at least cost.

Every row has at most one fault: blank, duplicate (role and text seen earlier in its conversation) or truncated (its last
visible character ends no sentence). Blank and duplicate rows must be deleted (cost 3). Any other row is kept (0), given the role user or
assistant (2) or deleted (3); an empty row of either role can be inserted anywhere (2); a truncated row that stays costs 1
more. The roles of the result, by their initials, are ``(s?(ua)+)?``. Of the cheapest repairs the one whose
edits spell the least string (Delete, Insert, Keep, Rerole) is chosen.

What a row may become depends on its role and fault alone, its symbol. Each symbol is a min-plus matrix over the four
states of the wanted order (nothing yet, after s, after u, after a). Equal consecutive symbols are a run, and a run is
the binary power of its matrix, cached per process. One conversation may hold a third of all rows, so
the work is done on small rows first: a fingerprint of the text, the turn and the symbol. They are sorted over the whole cluster
and cut into pieces of ``PIECE_ROWS`` rows. A piece's product tells what is still to pay at its beginning, whatever follows; then
the pieces are unrolled in order, each run by halves, which gives the edits. Texts are moved twice: to their edit, and into order.

Defined results: null roles and texts are one space; rows sort by turn (nulls first), role, the first ``HEAD`` characters and then
a fingerprint of the row, so equal rows are adjacent; a null conversation id is a conversation of its own; a conversation of which no row is left has no edits; an empty
table gives an empty table; further columns are left out. The audit of a conversation is one value.
"""

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sonoframe.llm.stored import stored
from sonoframe.operators.joins import HOT_ROWS, lookup_join

PIECE_ROWS = 4096
HEAD = 64
BATCH_ROWS = 4096

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: the last role of what is kept so far
STATES = range(4)
NEVER = 1 << 60
TO_PAY_AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
# Where a row of a role leads, where it may stand, and the roles that can be made.
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
MAY_FOLLOW = {"s": (NOTHING,), "u": (NOTHING, SYSTEM, ASSISTANT), "a": (USER,)}
MADE = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
FULL = {"u": "user", "a": "assistant"}

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
GONE = "-"  # the symbol of rows that must be deleted; others are the initial, and ! if truncated

PIECES = (
    "conv_id bigint, part int, piece int, product array<bigint>, turns array<bigint>, roles array<string>, rows array<binary>,"
    " faults array<string>, times array<bigint>"
)
EDITS = (
    "conv_id bigint, place bigint, edit string, times bigint, fault string, turn bigint, old_role string, new_role string, row binary"
)
SUMMARY = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)

DELETIONS = re.compile(f"{DELETE}*")

Vector = tuple[int, int, int, int]


def symbol(role: str, fault: str | None) -> str:
    if fault in (BLANK, DUPLICATE):
        return GONE
    return (role[:1] if role[:1] in AFTER else "?") + ("!" if fault == TRUNCATED else "")


@functools.cache
def choices(mark: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """The edits ``(initial, cost, next state)`` that take one row of a symbol, in a state."""
    found = [(DELETE, DELETE_COST, state)]
    if mark != GONE:
        more = TRUNCATED_COST if mark.endswith("!") else 0
        if state in MAY_FOLLOW.get(mark[0], ()):
            found.append((KEEP, more, AFTER[mark[0]]))
        found.append((REROLE, REROLE_COST + more, AFTER[MADE[state]]))
    return tuple(found)


def inserted(state: int) -> int:
    return AFTER[MADE[state]]


def times_vector(matrix: tuple, vector: Vector) -> Vector:
    return tuple(min(min(row[k] + vector[k] for k in STATES), NEVER) for row in matrix)


@functools.cache
def power(mark: str, exponent: int) -> tuple:
    """The min-plus matrix of ``2 ** exponent`` rows of a symbol; before each row up to three rows may be inserted."""
    if exponent:
        half = power(mark, exponent - 1)
        return tuple(tuple(min(min(row[k] + half[k][to] for k in STATES), NEVER) for to in STATES) for row in half)
    matrix = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        here, cost = state, 0
        for _ in range(4):
            for _, own, to in choices(mark, here):
                matrix[state][to] = min(matrix[state][to], cost + own)
            here, cost = inserted(here), cost + INSERT_COST
    return tuple(map(tuple, matrix))


@functools.lru_cache(1 << 16)
def _before(mark: str, rows: int, vector: Vector) -> Vector:
    exponent = 0
    while rows:
        if rows & 1:
            vector = times_vector(power(mark, exponent), vector)
        rows, exponent = rows >> 1, exponent + 1
    return vector


def reduced(vector: Vector) -> tuple[int, Vector]:
    least = min(vector)
    return least, tuple(v if v >= NEVER else v - least for v in vector)


def before(mark: str, rows: int, vector: Vector) -> Vector:
    """What is to pay before a run, from what is to pay after it."""
    least, small = reduced(vector)
    return tuple(v if v >= NEVER else v + least for v in _before(mark, rows, small))


@functools.lru_cache(1 << 16)
def _unrolled(mark: str, rows: int, state: int, vector: Vector) -> tuple[str, int]:
    if rows > 1:
        late = 1 << ((rows - 1).bit_length() - 1)  # a power of two, so the halves of runs are alike
        first, state = unrolled(mark, rows - late, state, before(mark, late, vector))
        last, state = unrolled(mark, late, state, vector)
        return first + last, state
    edits, owed = "", _before(mark, 1, vector)
    while True:
        # Of the cheapest ways on, the one with the least initial; Delete, Insert, Keep, Rerole are in that order.
        ways = [(e, to) for e, cost, to in choices(mark, state) if cost + vector[to] == owed[state]]
        if INSERT_COST + owed[inserted(state)] == owed[state]:
            ways.append((INSERT, inserted(state)))
        edit, state = min(ways)
        edits += edit
        if edit != INSERT:
            return edits, state


def unrolled(mark: str, rows: int, state: int, vector: Vector) -> tuple[str, int]:
    """The edits of a run, and the state after it."""
    return _unrolled(mark, rows, state, reduced(vector)[1])


def runs_of(symbols: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Equal neighbours collapsed."""
    runs: list[tuple[str, int]] = []
    for mark, n in symbols:
        if runs and runs[-1][0] == mark:
            runs[-1] = (mark, runs[-1][1] + n)
        elif n:
            runs.append((mark, n))
    return runs


def product(runs: list[tuple[str, int]]) -> list[int]:
    """The min-plus matrix of a list of runs, row by row."""
    columns = []
    for to in STATES:
        vector = tuple(0 if k == to else NEVER for k in STATES)
        for mark, n in reversed(runs):
            vector = before(mark, n, vector)
        columns.append(vector)
    return [columns[to][state] for state in STATES for to in STATES]


def edits_of(runs: list[tuple[str, int]], state: int, vector: Vector) -> tuple[str, int]:
    """The edits of a list of runs from a state, with ``vector`` to pay after them, and the state after them."""
    after = [vector]
    for mark, n in reversed(runs):
        after.append(before(mark, n, after[-1]))
    edits = []
    for (mark, n), owed in zip(runs, after[-2::-1], strict=True):
        done, state = unrolled(mark, n, state, owed)
        edits.append(done)
    return "".join(edits), state


def closing(state: int) -> str:
    """The rows inserted after the last."""
    edits = ""
    while TO_PAY_AT_END[state]:
        edits, state = edits + INSERT, inserted(state)
    return edits


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def fingerprint(*parts: Column) -> Column:
    """128 bits of the SHA-256 of values of which only the last may hold a colon."""
    told = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, 16)


def turn_rows(turns: DataFrame, copies: Column) -> DataFrame:
    """``(conv_id, turn, role, text)``, fingerprints of the whole row and of what makes it a duplicate, and how often it
    occurs. A row of 0 copies only names its conversation."""
    some = copies > 0
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.when(some, F.col("turn").cast("bigint")).alias("turn"),
        *[F.when(some, F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(c) for c in ("role", "text")],
        copies.cast("bigint").alias("copies"),
    )
    key = F.sha2(F.col("text").cast("binary"), 256)
    return rows.withColumns({
        "row": fingerprint(F.col("conv_id"), F.col("turn"), key, F.col("role")),
        "content": fingerprint(F.col("conv_id"), key, F.col("role")),
    })


def faulty_rows(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One small row for equal rows: ``(conv_id, turn, role, head, row, fault, times)``. ``fault`` is the first one's; the
    others are duplicates, or blank like it."""
    last = F.regexp_extract("text", r"([^ \t-\r])[ \t-\r]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).alias("fault")
    own = ["conv_id", "turn", "role", "head", "row", "content", "fault"]
    head = F.substring("text", 1, HEAD).alias("head")
    counted = rows.select("conv_id", "turn", "role", head, "row", "content", fault, "copies").groupBy(*own).agg(F.sum("copies").alias("times"))
    # A row is a duplicate if its role and text stand at an earlier turn.
    counted = counted.withColumn("order", F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn")))
    firsts = counted.groupBy("content").agg(F.min("order").alias("first"))
    found = lookup_join(counted, firsts, ["content"], "inner", hot_rows)
    again = (F.col("order") != F.col("first")) & ~F.col("fault").eqNullSafe(BLANK)
    fault = F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault")
    return found.select("conv_id", "turn", "role", "head", "row", fault, "times")


def cut_pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows in order, ``piece_rows`` of a conversation to a piece."""
    schema = _arrow(PIECES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, made, held, current = TaskContext.get().partitionId(), 0, [], None

        def finished() -> tuple:
            symbols = []
            for _, role, _, fault, times in held:
                mark = symbol(role, fault)
                symbols += [(mark, 1), (GONE, times - 1)]
            return (current[0], part, made, product(runs_of(symbols)), *map(list, zip(*held, strict=True))) if held else (
                current[0], part, made, product([]), [], [], [], [], [])

        for conv_id, *row, times in _rows(batches):
            if current != (conv_id,) or len(held) >= piece_rows:
                if current is not None:
                    yield finished()
                    made += 1
                current, held = (conv_id,), []
            if times:
                held.append((*row, times))
        if current is not None:
            yield finished()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(pieces(batches), schema, 256)

    order = ["conv_id", "turn", "role", "head", "row"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.select("conv_id", "turn", "role", "row", "fault", "times").mapInArrow(cut, PIECES)


def edit_rows(pieces: DataFrame) -> DataFrame:
    """The edits of all conversations, in ``place`` order. Copies that are deleted together are one row."""
    schema = _arrow(EDITS)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, owed, state, place, number = None, [], NOTHING, 0, 0

        def ending() -> Iterator[tuple]:
            made = state
            for k, _ in enumerate(closing(state)):
                yield current[0], place + k, INSERT, 1, None, None, None, FULL[MADE[made]], None
                made = inserted(made)

        for conv_id, kind, _, _, matrix, turns, roles, marks, faults, times in _rows(batches):
            if current != (conv_id,):
                if current is not None:
                    yield from ending()
                current, owed, state, place, number = (conv_id,), [], NOTHING, 0, 0
            if kind == 0:
                owed.append(matrix)  # all products of a conversation come before its first piece
                continue
            if number == 0:
                vector = TO_PAY_AT_END
                for i in range(len(owed) - 1, -1, -1):
                    matrix, owed[i] = owed[i], vector
                    vector = times_vector(tuple(tuple(matrix[4 * k : 4 * k + 4]) for k in STATES), vector)
            symbols = [(symbol(r, f), n) for r, f, n in zip(roles, faults, times, strict=True)]
            runs = runs_of([part for mark, n in symbols for part in ((mark, 1), (GONE, n - 1))])
            made, after = edits_of(runs, state, owed[number])
            number, at = number + 1, 0
            for turn, role, mark, fault, n in zip(turns, roles, marks, faults, times, strict=True):
                left = n
                while left:
                    edit = made[at]
                    if edit == INSERT:
                        yield current[0], place, INSERT, 1, None, None, None, FULL[MADE[state]], None
                        state, at, place = inserted(state), at + 1, place + 1
                        continue
                    first = left == n
                    kind_of = fault if first or fault == BLANK else DUPLICATE
                    together = 1
                    if edit == DELETE and not first:
                        # The further copies; nothing but an insertion can lie between them.
                        together = DELETIONS.match(made, at, at + left).end() - at
                    new_role = None if edit == DELETE else role if edit == KEEP else FULL[MADE[state]]
                    yield current[0], place, edit, together, kind_of, turn, role, new_role, mark
                    if edit != DELETE:
                        state = AFTER[new_role[0]]
                    left, at, place = left - together, at + together, place + together
            if state != after or at != len(made):
                raise RuntimeError("edits and rows of a piece do not agree")
            if not roles and place == 0 and number == len(owed):
                yield current[0], 0, None, 0, None, None, None, None, None
        if current is not None:
            yield from ending()

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(edits(batches), schema)

    names = ["conv_id", "kind", "part", "piece", "product", "turns", "roles", "rows", "faults", "times"]
    arrays = names[5:]
    kinds = [(0, lambda c: F.lit(None).cast(pieces.schema[c].dataType) if c in arrays else F.col(c)), (1, F.col)]
    both = [pieces.select(*[F.lit(k).alias(c) if c == "kind" else column(c).alias(c) for c in names]) for k, column in kinds]
    in_order = both[0].unionByName(both[1]).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "piece")
    return in_order.mapInArrow(unroll, EDITS)


def repaired(turns: DataFrame, copies: Column | None = None, piece_rows: int = PIECE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All edits of the conversations of ``(conv_id, turn, role, text)``: ``conv_id, place, edit, times, fault, turn, old_role,
    new_role, text``. The rows that stay or are inserted, by ``place``, are the repaired conversation. ``copies`` tells how
    often each row counts. A conversation without rows has one row without an edit."""
    rows = turn_rows(turns, F.lit(1) if copies is None else copies)
    edits = edit_rows(stored(cut_pieces(faulty_rows(rows, hot_rows), piece_rows), "structure-pieces"))
    # Only rows that stay need their text, and each of them is another one, so no key of this join is hot.
    texts = rows.filter("copies > 0").groupBy("row").agg(F.first("text").alias("text"))
    nothing = F.substring(fingerprint(F.col("conv_id"), F.col("place")), 1, 8)
    edits = edits.withColumn("row", F.when(F.col("edit").isin(KEEP, REROLE), F.col("row")).otherwise(nothing))
    text = F.when(F.col("edit") == INSERT, F.lit("")).otherwise(F.col("text")).alias("text")
    found = edits.join(texts, "row", "left")
    return found.select("conv_id", "place", "edit", "times", "fault", "turn", "old_role", "new_role", text)


def summary(edits: DataFrame) -> DataFrame:
    """Per conversation: missing turn numbers, faults, neighbours in wrong order, cost, audit and a digest of the result."""
    schema = _arrow(SUMMARY)

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current = None
        for conv_id, _, edit, times, fault, turn, old_role, new_role, text in _rows(batches):
            if current != (conv_id,):
                if current is not None:
                    yield row()
                current = (conv_id,)
                audit, digest, kept, cost, illegal, last = [], hashlib.sha256(), 0, 0, 0, None
                faults, distinct, least, most = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}, 0, None, None

                def row() -> tuple:
                    gaps = 0 if most is None else most - least + 1 - distinct
                    return (current[0], gaps, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest())

            if edit is None:
                continue
            audit.append(edit * times)
            cost += {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST * times, INSERT: INSERT_COST}[edit]
            if edit != DELETE:
                cost += TRUNCATED_COST if fault == TRUNCATED else 0
                digest.update(f"{chr(10) if kept else ''}{new_role}:{text}".encode())
                kept += 1
            if edit != INSERT:
                if fault:
                    faults[fault] += times
                own = old_role[:1]
                if last is not None:
                    illegal += last + own not in ("su", "ua", "au")
                illegal += times - 1  # copies side by side
                last = own
                if turn is not None and turn != most:
                    distinct, least, most = distinct + 1, turn if least is None else least, turn
        if current is not None:
            yield row()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(conversations(batches), schema, 64)

    rows = edits.select("conv_id", "place", "edit", "times", "fault", "turn", "old_role", "new_role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(tell, SUMMARY)
