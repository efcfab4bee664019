"""Periodic runs of words, found online on sparse diagonals.

A run of period q is a diagonal: words that equal the word q places before them, one after the other. For each word
its earlier occurrence at lag q lengthens the match of that lag by one; where the next word does not, the diagonal has
ended, and it is emitted at once if it is long enough.

A frequent word has very many earlier occurrences, and nearly all of their diagonals are short. So an occurrence is told
together with the words before it: level F = 1, 2, 4, ... looks at the F words that end at each place, and follows
the lags from F / 2 + 1 to F. Only the nearest earlier occurrence there is followed, which loses nothing: inside a run of
smallest period q <= F < 2 q the F words that end at a place (from the first q + F words on) occur q places before. A nearer
occurrence d would give a stretch of q + d words the periods d and q, so their common divisor too, and the run a
smaller period. A run has three periods at least, so it holds such a place, and then all to its end; and what is followed
for three periods has no smaller one, by the same argument. A place stays at the next level only if both its halves
are repeated. All places of many documents step together, in O(words * log(words)).

Defined results: a null text and one without words have no run and the empty text; runs of one text are sorted by
start, then period; equal rows get equal results; an empty table gives an empty table; columns named like the
results are replaced. A text is one value and is looked at by one task, in about 100 bytes per word.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sonoframe.llm.words import words

LEAST_WORDS = 24
LEAST_PERIODS = 3
SLICE_BYTES = 4 << 20  # of text looked at together, or one text

RESULT = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Runs(NamedTuple):
    start: np.ndarray  # places in the sequence of all documents
    length: np.ndarray
    period: np.ndarray


def earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every place the number of its key, the nearest earlier place with it (-1: none), and whether it is repeated."""
    order = np.argsort(keys, kind="stable")
    listed = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = listed[1:] != listed[:-1]
    number, before, repeated = np.empty(len(keys), np.int64), np.full(len(keys), -1, np.int64), np.empty(len(keys), bool)
    number[order] = np.cumsum(first) - 1
    again = np.flatnonzero(~first)
    before[order[again]] = order[again - 1]
    repeated[order] = ~first | np.append(~first[1:], False)
    return number, before, repeated


def find_runs(codes: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Runs:
    """All runs of documents whose words are ``codes[bounds[i]:bounds[i + 1]]``."""
    if least_periods < 3:
        raise ValueError("a run needs three periods at least")
    sizes = np.diff(bounds)
    longest = int(sizes.max()) if len(sizes) else 0
    doc = np.repeat(np.arange(len(sizes)), sizes)
    places, keys = np.arange(len(codes)), doc * (int(codes.max()) + 1 if len(codes) else 1) + codes
    index = np.full(len(codes), -1, np.int64)  # of a place among those that are left
    found, level = [], 1
    while len(places) and (level // 2 + 1) * least_periods <= longest:
        number, before, repeated = earlier(keys)
        lag = np.where(before >= 0, places - places[before], 0)
        followed = np.flatnonzero((2 * lag > level) & (lag <= level))
        if len(followed):
            # The match of a lag grows while the next place follows the same lag; where not, it has ended.
            at, lags = places[followed], lag[followed]
            begins = np.ones(len(at), bool)
            begins[1:] = (at[1:] != at[:-1] + 1) | (lags[1:] != lags[:-1])
            begin = np.flatnonzero(begins)
            end = np.append(begin[1:], len(at)) - 1
            period = lags[begin]
            start = at[begin] - level + 1 - period
            length = at[end] - start + 1
            long = length >= np.maximum(least_words, least_periods * period)
            found.append((start[long], length[long], period[long]))
        places, number = places[repeated], number[repeated]
        index[:] = -1
        index[places] = np.arange(len(places))
        far = places - level
        whole = (far >= 0) & (index[far] >= 0) & (doc[far] == doc[places])
        keys = number[index[far[whole]]] * (int(number.max()) + 1 if len(number) else 1) + number[whole]
        places, level = places[whole], 2 * level
    if not found:
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    start, length, period = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def look_at(texts: pa.Array, least_words: int, least_periods: int) -> pa.Array:
    """``RESULT`` of every text."""
    counts, runs, kept = [], [], []
    for found in words(texts, SLICE_BYTES):
        here = find_runs(found.codes, found.bounds, least_words, least_periods)
        of = np.searchsorted(found.bounds, here.start, side="right") - 1
        struct = pa.StructArray.from_arrays(
            [pa.array(here.start - found.bounds[of]), pa.array(here.length), pa.array(here.period)], fields=list(RUN)
        )
        offsets = np.searchsorted(of, np.arange(len(found.bounds)))
        runs.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct))
        covers = np.zeros(len(found.codes) + 1, np.int64)
        np.add.at(covers, here.start + here.period, 1)
        np.add.at(covers, here.start + here.length, -1)
        keep = np.cumsum(covers[:-1]) == 0
        offsets = np.concatenate(([0], np.cumsum(keep)))[found.bounds]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found.distinct.take(pa.array(found.codes[keep])))
        kept.append(pc.binary_join(lists, " "))
        counts.append(np.diff(found.bounds))
    if not counts:
        return pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())]))
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(counts)), pa.concat_arrays(runs), pa.concat_arrays(kept)], ["n_words", "runs", "collapsed"]
    )


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with the ``n_words`` of its ``text``, its ``runs`` (start, length and period, in words) and ``collapsed``,
    the words outside of runs and of each run the first period, joined by spaces."""
    if least_periods < 3:
        raise ValueError("a run needs three periods at least")

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        return look_at(texts, least_words, least_periods)

    own = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    looked = docs.select(*own, found(F.col("text").cast("string")).alias("_found"))
    return looked.select(*own, *[F.col(f"_found.{c}").alias(c) for c in ("n_words", "runs", "collapsed")])
