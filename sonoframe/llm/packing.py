"""Sum-of-squares online packing of documents into token windows.

A document longer than a window fills whole windows; what is left is one piece. Pieces come one
by one and go to the fill level that keeps the sum over all levels of (partly filled windows at
that level) squared smallest, a new window included. Only an array with the number of windows
at each level is looked at.

Texts are tokenised where they are read. Only the small rows of pieces are then dealt, by a hash,
to tasks that each pack their share on their own. The number of shares follows the number of
documents, so each has enough pieces to fill its windows.

Defined results: a null or empty text is a document with the end token alone; equal documents, ids
or rows are packed once per row; an empty table gives an empty table.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sonoframe.llm.tokens import ragged, token_ids

WINDOW = 2048
END_TOKEN = 1
SHARE = 50_000  # documents to a share
SEQUENCE_BITS = 36  # of a sequence's id, below its share's number

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids array<int>"
PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"


def cut_documents(docs: DataFrame, window: int = WINDOW, end_token: int = END_TOKEN, keep_ids: bool = True) -> DataFrame:
    """Pieces of every document: whole windows, then the rest. ``ids`` is null unless they are kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            documents = [np.append(ids, np.int32(end_token)) for ids in token_ids(batch.column("text"))]
            totals = np.array([len(ids) for ids in documents], np.int64)
            counts = -(-totals // window)
            row = np.repeat(np.arange(len(totals)), counts)
            start = ragged(np.zeros(len(totals), np.int64), counts) * window
            length = np.minimum(window, totals[row] - start)
            pieces = [documents[r][s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(p.astype("<u4")) for p in pieces], pa.int64()),
                    pa.array(totals[row]),
                    pa.array([p if keep_ids else None for p in pieces], pa.list_(pa.int32())),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, PIECES)


class LevelArray:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The window for a piece and the fill level it starts at."""
        top = self.window - length
        # Moving a window from level h to h + length changes the sum by 2 (N[h + length] - N[h] + 1);
        # a full or an empty window does not count.
        count = self.count
        after = count[length : self.window + 1].copy()
        gain = after * 2 + 1
        gain[top] = 0
        gain[1:] += 1 - 2 * count[1 : top + 1]
        gain[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = int(len(gain) - 1 - np.argmin(gain[::-1]))  # among equals the fullest
        if level:
            sequence = self.open[level].pop()
            count[level] -= 1
        else:
            sequence = self.made
            self.made += 1
        if level < top:
            self.open[level + length].append(sequence)
            count[level + length] += 1
        return sequence, level


def place_pieces(pieces: DataFrame, shares: int, window: int = WINDOW) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; each share packs its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, share = LevelArray(window), TaskContext.get().partitionId()
        for batch in batches:
            placed = [levels.place(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([(share << SEQUENCE_BITS) + s for s, _ in placed], pa.int64())
            offset = pa.array([o for _, o in placed], pa.int64())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"sequence_id": sequence, "offset": offset}
            names = [f.strip().split()[0] for f in PLACED.split(",")]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    # Pieces are sorted, so a share that is packed again gets the same windows.
    dealt = pieces.repartition(shares, F.xxhash64("doc_id", "start", "ids_crc32"))
    return dealt.sortWithinPartitions(F.xxhash64("doc_id", "start"), "doc_id", "start", "ids_crc32").mapInArrow(pack, PLACED)


def pack_documents(docs: DataFrame, window: int = WINDOW, end_token: int = END_TOKEN, share: int = SHARE, keep_ids: bool = True) -> DataFrame:
    """Where every piece of every document of ``(doc_id, text)`` lies."""
    shares = max(1, -(-docs.count() // share))
    return place_pieces(cut_documents(docs, window, end_token, keep_ids), shares, window)


def sequences(placed: DataFrame, window: int = WINDOW, pad_token: int = 0) -> DataFrame:
    """``(sequence_id, ids)``: the padded windows. A window is one value of bounded size."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    ids = F.flatten(parts)
    padded = F.concat(ids, F.array_repeat(F.lit(pad_token), F.lit(window) - F.size(ids)))
    return placed.groupBy("sequence_id").agg(padded.alias("ids"))
