"""Edit distance on words, many words at a time.

Differences between neighbouring cells of the distance table are -1, 0 or 1, so a column of it is two bit vectors, which a handful of
operations on whole integers takes to the next column. Memory is one column, whatever the lengths. What both texts
begin and end with is left out first. Long texts are first compared within a band about the diagonal, which is widened until the
distance found is one that needs no cell outside.
"""

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from sonoframe.functions.text import WHITESPACE, char_class, strip

BAND = 64  # cells to either side of the diagonal that are tried first
BAND_GROWTH = 4


def words(text: Column) -> Column:
    """Words of a sentence: two or more white-space characters count as one space,
    outer white space goes, and the rest is cut at single spaces."""
    single_spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{char_class(WHITESPACE)}]{{2,}}", " ")
    return F.filter(F.split(strip(single_spaced), " "), lambda w: w != "")


def band_distance(positions: dict, m: int, hypothesis: list, band: int | None) -> int:
    """Distance of ``m`` words, given as the bits at which each of them stands, to others. With a ``band`` only rows within so
    many of the diagonal are looked at: the result is then no less than the distance, and equal to it if that is no more than the band."""
    n = len(hypothesis)
    width = m if band is None else min(m, 2 * band + 1)
    full = (1 << width) - 1
    up, down = full, 0  # rows where the column grows or falls by one
    edge, first = 0, 1  # the cell above the first row looked at, and that row's number
    for j, word in enumerate(hypothesis, 1):
        if band is not None and j - band > first and first + width <= m:
            edge += (up & 1) - (down & 1)
            up, down, first = up >> 1 | 1 << (width - 1), down >> 1, first + 1
        edge += 1
        same = (positions.get(word, 0) >> (first - 1)) & full
        flat = ((((same & up) + up) ^ up) | same | down) & full  # the diagonal step costs nothing
        right, left = down | (full & ~(flat | up)), flat & up
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = left | (full & ~(flat | right)), right & flat
    seen = (1 << (m - first + 1)) - 1
    return edge + (up & seen).bit_count() - (down & seen).bit_count()


def edit_distance(reference: list, hypothesis: list) -> int:
    """Substitutions, insertions and deletions between two lists."""
    begin, m, n = 0, len(reference), len(hypothesis)
    while begin < min(m, n) and reference[begin] == hypothesis[begin]:
        begin += 1
    while m > begin and n > begin and reference[m - 1] == hypothesis[n - 1]:
        m, n = m - 1, n - 1
    reference, hypothesis = reference[begin:m], hypothesis[begin:n]
    if len(reference) < len(hypothesis):
        reference, hypothesis = hypothesis, reference
    m, n = len(reference), len(hypothesis)
    if not n:
        return m
    places: dict = {}
    for i, word in enumerate(reference):
        places.setdefault(word, []).append(i)
    positions = {word: sum(1 << i for i in at) for word, at in places.items()}
    band = max(BAND, m - n)
    while 4 * band < m:
        found = band_distance(positions, m, hypothesis, band)
        if found <= band:
            return found
        band *= BAND_GROWTH
    return band_distance(positions, m, hypothesis, None)


@F.arrow_udf(T.IntegerType())
def _edits(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    pairs = zip(references.to_pylist(), hypotheses.to_pylist(), strict=True)
    return pa.array([None if r is None or h is None else edit_distance(r, h) for r, h in pairs], pa.int32())


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Substitutions, insertions and deletions between two arrays of words; missing if either is. Texts may have any
    number of words."""
    return _edits(reference, hypothesis)
