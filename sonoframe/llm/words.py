"""Words of whole texts as codes into a list of distinct words, a slice of rows at a time."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20  # of text looked at together, or one text


class Words(NamedTuple):
    begin: int  # rows begin .. end - 1 of the column
    end: int
    bounds: np.ndarray  # row begin + i has the words bounds[i] .. bounds[i + 1] - 1
    codes: np.ndarray
    distinct: pa.StringArray


def row_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Maximal runs of characters other than space and U+0009 to U+000D. A null text has none."""
    for begin, end in row_slices(texts, limit):
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts.slice(begin, end - begin), ""))
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        # White space at either end of a text gives an empty word there.
        empty = coded.dictionary.index("").as_py()
        if empty >= 0:
            full = codes != empty
            bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
            codes = codes[full]
        yield Words(begin, end, bounds, codes, coded.dictionary)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``, 0 for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def code_points(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the words, one word after the other, and where each word starts."""
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, content = distinct.cast(pa.string()).buffers()
    bounds = np.frombuffer(offsets, np.int32)[distinct.offset : distinct.offset + len(distinct) + 1] if len(distinct) else [0]
    joined = bytes(content[int(bounds[0]) : int(bounds[-1])]) if content is not None else b""
    points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
    return points.astype(np.uint64), np.concatenate(([0], np.cumsum(lengths)))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial in its characters, then mixed."""
    points, starts = code_points(distinct)
    if not len(points):
        return mix(np.full(len(distinct), seed, np.uint64) + MULTIPLIER)
    lengths = np.diff(starts)
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest, MULTIPLIER | np.uint64(1), np.uint64))
    place = np.arange(len(points)) - np.repeat(starts[:-1], lengths)
    terms = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(points + np.uint64(seed)) * powers[place], dtype=np.uint64)))
    sums = terms[starts[1:]] - terms[starts[:-1]]
    return mix(sums + lengths.astype(np.uint64) * np.uint64(seed * 2 + 1))
