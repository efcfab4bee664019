"""Joins on an utterance id.

The right side of every join here has one row per id, so a join never grows the
left side. An id that very many left rows share is spread over tasks by
``lookup_join``. The adaptive skew join of Spark cannot do that here: the right side
is usually an aggregate by the same id, which it does not split.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000  # an id with at least so many rows is hot, and is cut into pieces of that size
HEAVY = 1024  # counters of the sketch: an id with more than this part of all rows is in it
NULL_PIECES = 1024  # rows without an id match nothing; they may lie anywhere


def reduced_counters(hashes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries counters brought down to ``most``: the largest, each less the first that is left out."""
    names, at = np.unique(hashes, return_inverse=True)
    total = np.bincount(at, counts, len(names)).astype(np.int64)
    if len(names) <= most:
        return names, total
    order = np.lexsort((names, -total))
    over = total[order[most]]
    kept = order[:most][total[order[:most]] > over]
    return names[kept], total[kept] - over


def heavy_hitters(df: DataFrame, keys: list[str], least: int = 1, most: int = HEAVY) -> dict[int, int]:
    """Hashes of the keys that many rows share, with counts that fall short by a ``most``-th of all rows at worst.

    A task keeps ``most`` counters for all of its rows. Those of all tasks are added up, and the ``most`` largest
    of at least ``least`` reach the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            hashes, counts = reduced_counters(np.concatenate((hashes, own)), np.concatenate((counts, np.ones(len(own), np.int64))), most)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["hash", "n"])

    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    local = df.filter(present).select(F.xxhash64(*keys).alias("hash")).mapInArrow(counted, "hash bigint, n bigint")
    added = local.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {row["hash"]: row["n"] for row in added.orderBy(F.desc("n"), "hash").limit(most).collect()}


def hot_pieces(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> dict[int, int]:
    """The number of pieces each hot key is to be cut into, by its hash: ``HEAVY`` entries at most, mostly none. A key
    that is not among them has less than a ``HEAVY``-th of all rows."""
    return {h: 1 + n // hot_rows for h, n in heavy_hitters(df, keys, hot_rows).items()}


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``left`` with the one row of ``right`` that has its key.

    One pass over the left keys finds the hot ones, before the join is planned. If there are none, it is an ordinary join. Otherwise
    rows of a hot key are dealt to several tasks by a hash of their content, which a repeated task computes again, and only
    the right rows of hot keys are copied. Either side moves once.
    """
    hot = hot_pieces(left, keys, hot_rows)
    if not hot:
        return left.join(right, keys, how)
    table = F.create_map(*[F.lit(v) for pair in hot.items() for v in pair])
    pieces = F.coalesce(F.try_element_at(table, F.xxhash64(*keys)), F.lit(1)).cast("bigint")
    unmatchable = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    dealt = left.withColumn("_piece", F.pmod(F.xxhash64(*left.columns), F.when(unmatchable, NULL_PIECES).otherwise(pieces)))
    copied = right.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    return dealt.join(copied, [*keys, "_piece"], how).drop("_piece")


def join_prompts(waves: DataFrame, prompts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Waves that have a prompt. ``prompts`` has one row per ``utt_id``."""
    return lookup_join(waves, prompts, ["utt_id"], "inner", hot_rows)


def unmatched_waves(waves: DataFrame, prompts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Waves without a prompt."""
    return lookup_join(waves, prompts.select("utt_id"), ["utt_id"], "left_anti", hot_rows)


def pair_hypotheses(
    references: DataFrame, hypotheses: DataFrame, keys: list[str], reference: str, hypothesis: str
) -> DataFrame:
    """Every reference with its hypothesis; a missing one reads as empty text.

    Both sides have one row per key, so no key can be hot.
    """
    right = hypotheses.select(*keys, F.col(hypothesis).alias("hypothesis"))
    return references.join(right, keys, "left").select(
        *keys,
        F.coalesce(F.col(reference), F.lit("")).alias("reference"),
        F.coalesce("hypothesis", F.lit("")).alias("hypothesis"),
    )
