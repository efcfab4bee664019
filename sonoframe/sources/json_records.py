"""Objects of JSON files of any layout, cut apart by all tasks together.

Where an object ends cannot be told from a piece of a file alone: a brace may stand in a string, and an object in
another one. So every file is cut into chunks of a few megabytes, at opening braces, and a structural scan gives for each chunk
a small map: from the state it may be entered in (outside of strings, in a string, after a backslash there) to the state it
is left in, how much deeper the nesting is then, and how shallow it was on the way. The maps of a file, one small row per chunk, are
composed in file order. Every chunk then knows its state and depth, and cuts its objects exactly.

An object that reaches over the end of its chunk is put together from its fragments, of which every chunk has two at most.
The objects of an array and those that stand one after the other (JSON lines, in any layout) are told
apart per file by its first character. Files of both kinds may lie in one folder; nothing is decided per file on the driver.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoframe.shared import shared_path
from sonoframe.sources.files import load_existing

CHUNK_BYTES = 4 << 20
OUTSIDE, STRING, ESCAPED = range(3)
MODES = (OUTSIDE, STRING, ESCAPED)

_CHUNKS = "file string, block bigint, no int, text string, opens_array boolean, exits array<int>, deeper array<bigint>, lowest array<bigint>"
_ENTRIES = "file string, block bigint, no int, mode int, depth bigint, is_array boolean, owner_block bigint, owner_no int"
_PIECES = "owner_file string, owner_block bigint, owner_no int, block bigint, no int, value string"
_BLANK = b" \t\r\n"
_BYTE_ORDER_MARK = "﻿".encode()


class Scan(NamedTuple):
    places: np.ndarray  # of braces and brackets outside of strings
    steps: np.ndarray  # 1 or -1
    exit: int


def scan(content: np.ndarray, mode: int) -> Scan:
    """The structure of bytes that are entered in a mode."""
    quotes, others = np.flatnonzero(content == 34), None
    tail_escaped = mode == ESCAPED and not len(content)
    if (content == 92).any() or mode == ESCAPED:
        # A character is escaped by an odd number of backslashes right before it.
        others = np.flatnonzero(content != 92)
        at = np.searchsorted(others, quotes)
        before = np.where(at > 0, others[at - 1], -1)
        slashes = quotes - before - 1 + ((before < 0) & (mode == ESCAPED))
        quotes = quotes[slashes % 2 == 0]
        last = int(others[-1]) if len(others) else -1
        tail_escaped = (len(content) - last - 1 + (last < 0 and mode == ESCAPED)) % 2 == 1
    inside = int(mode != OUTSIDE)
    low = content | 32  # [ and { differ in this bit alone, as do ] and }
    places = np.flatnonzero((low == 123) | (low == 125))
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    steps = np.where(low[places] == 123, 1, -1)
    in_string = (len(quotes) + inside) % 2 == 1
    return Scan(places, steps, (ESCAPED if tail_escaped else STRING) if in_string else OUTSIDE)


def _map(content: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    exits, deeper, lowest = [], [], []
    for mode in MODES:
        found = scan(content, mode)
        depth = np.cumsum(found.steps)
        exits.append(found.exit)
        deeper.append(int(depth[-1]) if len(depth) else 0)
        lowest.append(min(0, int(depth.min())) if len(depth) else 0)
    return exits, deeper, lowest


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


def _opening_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between opening braces of all files, in file order within a task."""
    cut = load_existing(lambda: spark.read.option("lineSep", "{").text(path), f"manifest not found: {path}")
    return cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def holds_arrays(spark: SparkSession, path: str) -> bool:
    """Whether any file below a path begins with a bracket."""
    pieces = _opening_pieces(spark, path).filter("block = 0")
    begins = F.regexp_replace("value", r"^[\s\x{feff}]+", "").startswith("[")
    # The first piece of a file has the least number of all of its pieces.
    first = pieces.select("file", begins.alias("begins"), F.monotonically_increasing_id().alias("at")).groupBy("file")
    found = first.agg(F.min_by("begins", "at").alias("begins")).filter("begins").limit(1)
    return bool(found.count())


def json_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The files below a path as chunks with their structural maps. A chunk begins at an opening brace, or its file."""
    schema = _arrow(_CHUNKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, number = None, [], 0, 0

        def finished() -> pa.RecordBatch:
            first = current[1] == 0 and number == 0
            text = ("" if first else "{") + "{".join(held)
            content = text.encode()
            if first:
                content = content.removeprefix(_BYTE_ORDER_MARK)
                text = content.decode()
            opens = content.lstrip(_BLANK).startswith(b"[") if first else None
            return _batch([(*current, number, text, opens, *_map(np.frombuffer(content, np.uint8)))], schema)

        for file, block, value in _rows(batches):
            if current != (file, block) or size >= chunk_bytes:
                if current is not None:
                    yield finished()
                number = number + 1 if current == (file, block) else 0
                current, held, size = (file, block), [], 0
            held.append(value)
            size += len(value) + 1
        if current is not None:
            yield finished()

    return _opening_pieces(spark, path).mapInArrow(cut, _CHUNKS)


def chunk_entries(chunks: DataFrame) -> DataFrame:
    """State, depth and owner of every chunk. The owner is the chunk in which the object that it begins in was opened."""
    schema = _arrow(_ENTRIES)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mode, depth, is_array, owner, out = None, OUTSIDE, 0, False, (None, None), []

        def check() -> None:
            if current is not None and (mode != OUTSIDE or depth != 0):
                raise ValueError(f"{current} ends within a value")

        for file, block, no, opens, exits, deeper, lowest in _rows(batches):
            if file != current:
                check()
                current, mode, depth, is_array, owner = file, OUTSIDE, 0, bool(opens), (None, None)
            out.append((file, block, no, mode, depth, is_array, *owner))
            level = int(is_array)
            if not (depth > level and depth + lowest[mode] > level):
                owner = (block, no) if depth + deeper[mode] > level else (None, None)
            mode, depth = exits[mode], depth + deeper[mode]
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        check()
        yield _batch(out, schema)

    order = ["file", "block", "no"]
    maps = chunks.select(*order, "opens_array", "exits", "deeper", "lowest")
    return maps.repartition("file").sortWithinPartitions(*order).mapInArrow(compose, _ENTRIES)


def cut_objects(content: bytes, mode: int, depth: int, is_array: bool) -> tuple[bytes | None, list[bytes], bytes | None]:
    """The end of an object that was begun before, the whole objects, and the beginning of one that goes on."""
    level, found = int(is_array), scan(np.frombuffer(content, np.uint8), mode)
    after = depth + np.cumsum(found.steps)
    opens = found.places[(found.steps > 0) & (after == level + 1)]
    closes = found.places[(found.steps < 0) & (after == level)] + 1
    if (after < 0).any():
        raise ValueError("a bracket is closed that was not opened")
    head = tail = None
    if depth > level:
        if not len(closes):
            return content, [], None
        head, closes = content[: closes[0]], closes[1:]
    if len(opens) > len(closes):
        tail, opens = content[opens[-1] :], opens[:-1]
    # What lies between objects is blank, a comma, or the brackets of the file's own array.
    edges = [len(head or b""), *np.column_stack((opens, closes)).ravel().tolist(), len(content) - len(tail or b"")]
    between = b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    if between.translate(None, _BLANK + (b",[]" if is_array else b"")):
        raise ValueError(f"expected objects only, found {between.strip()[:40]!r}")
    return head, [content[a:b] for a, b in zip(opens.tolist(), closes.tolist(), strict=True)], tail


def json_objects(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The text of every object, column ``value``. The files are read once; the chunks are stored in the shared folder."""
    place = shared_path(spark, "json-chunks")
    json_chunks(spark, path, chunk_bytes).write.parquet(place)
    chunks = spark.read.schema(_CHUNKS).parquet(place)
    placed = chunks.select("file", "block", "no", "text").join(chunk_entries(chunks), ["file", "block", "no"])
    schema = _arrow(_PIECES)

    def pieces_of(fragments: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for file, block, no, text, mode, depth, is_array, owner_block, owner_no in _rows(batches):
                try:
                    head, whole, tail = cut_objects(text.encode(), mode, depth, is_array)
                except ValueError as error:
                    raise ValueError(f"{file}: {error}") from error
                rows = [] if fragments else [(file, block, no, block, no, w.decode()) for w in whole]
                if fragments and head is not None:
                    rows.append((file, owner_block, owner_no, block, no, head.decode()))
                if fragments and tail is not None:
                    rows.append((file, block, no, block, no, tail.decode()))
                yield _batch(rows, schema)

        return cut

    fragments = placed.mapInArrow(pieces_of(True), _PIECES).groupBy("owner_file", "owner_block", "owner_no")
    in_order = F.sort_array(F.collect_list(F.struct("block", "no", "value")))
    joined = fragments.agg(F.array_join(F.transform(in_order, lambda p: p["value"]), "").alias("value"))
    return placed.mapInArrow(pieces_of(False), _PIECES).select("value").union(joined.select("value"))
