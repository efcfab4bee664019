"""Document quality by a factorisation machine.

A document is a sparse vector: its hashed distinct words with damped counts, structure
statistics of its text, and how long it is. The score is a logistic function of a linear part
plus all pairwise interactions, whose weights are inner products of short factor vectors. Their
sum over all pairs is taken in linear time: half of (the square of the sum less the sum of the
squares), per factor.

The model is fitted on the driver by AdaGrad, on a bounded sample of labelled documents
(``PER_LABEL`` of either label, the words of at most ``MAX_TEXT_BYTES`` each but the statistics of the whole text), weighted back to the labels' shares. It has
a fixed size and is broadcast; whole texts are scored where they are read.

Defined results: a null or empty text is scored from its (empty) statistics; without usable
labels every score is 0.5; repeated rows get equal scores.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sonoframe.llm.samples import excerpt, held_out, one_per_id, sampled_ids
from sonoframe.llm.words import Words, segment_sums, word_hashes, words

PER_LABEL = 1500
BUCKETS = 1 << 15
FACTORS = 8
WORD_SCALE = 0.5  # norm of a document's word part, so statistics and words weigh alike
STATISTICS = 11


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray  # of the statistics
    spread: np.ndarray


def word_kinds(distinct: pa.Array) -> np.ndarray:
    """Per distinct word: characters, letters, capitals, digits, marks, whether it ends a sentence,
    whether it repeats one mark."""
    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)

    def has(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)

    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    return np.column_stack(
        [length, count(r"\p{L}"), count(r"\p{Lu}"), count(r"\p{Nd}"), count(r"[!-/:-@\[-`{-~]"), has(r"[.!?]$"), has(r"[#*$%&|<>!]$")]
    ).astype(np.float64)


def vectors(found: Words, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, feature numbers and values of the word parts, and the statistics, of a slice's documents."""
    n_docs = len(found.bounds) - 1
    n = np.diff(found.bounds)
    doc = np.repeat(np.arange(n_docs), n)
    pairs, counts = np.unique(doc * len(found.distinct) + found.codes, return_counts=True)
    of, code = np.divmod(pairs, max(1, len(found.distinct)))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n_docs)))).astype(np.int64)
    value = 1 + np.log(counts)
    norm = np.sqrt(segment_sums(value**2, bounds))
    value = WORD_SCALE * value / np.maximum(norm, 1e-9)[of]
    number = (word_hashes(found.distinct, 5) % np.uint64(BUCKETS)).astype(np.int64)[code]

    sums = segment_sums(word_kinds(found.distinct)[found.codes], found.bounds)
    some, chars = np.maximum(n, 1), np.maximum(sums[:, 0], 1)
    again = np.zeros(len(found.codes), bool)
    again[1:] = found.codes[1:] == found.codes[:-1]
    again[found.bounds[:-1][n > 0]] = False
    stuttered = segment_sums(again, found.bounds)
    statistics = np.column_stack(
        [
            np.log1p(n), sums[:, 0] / some, sums[:, 1] / chars, sums[:, 2] / chars, sums[:, 3] / chars, sums[:, 4] / chars,
            sums[:, 5] / some, sums[:, 6] / some, np.diff(bounds) / some, stuttered / some, np.log1p(lines),
        ]
    )
    return bounds, number, value, statistics


def raw_scores(model: Model, bounds: np.ndarray, number: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> np.ndarray:
    """Linear part plus all pairs, by the sum-of-squares identity."""
    z = (statistics - model.centre) / model.spread
    w, v = model.linear, model.factors
    weighted = v[number] * value[:, None]
    sums = segment_sums(weighted, bounds) + z @ v[BUCKETS:]
    squares = segment_sums(weighted**2, bounds) + z**2 @ v[BUCKETS:] ** 2
    line = segment_sums(w[number] * value, bounds) + z @ w[BUCKETS:]
    return model.bias + line + 0.5 * (sums**2 - squares).sum(axis=1)


def line_counts(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(sample: list[tuple[str, int, float]], seed: int = 5, rounds: int = 12, batch: int = 64, rate: float = 0.05, penalty: float = 1e-4) -> Model:
    """Learn from ``(text, label, weight)`` rows; a fourth value holds the statistics if the text is only a part."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    start = Model(0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), np.zeros(STATISTICS), np.ones(STATISTICS))
    sample = sorted(sample, key=lambda r: (r[0] or "", r[1]))
    if not sample:
        return start._replace(factors=np.zeros((size, FACTORS)))
    texts = pa.array([r[0] for r in sample], pa.string())
    y, weight = np.array([r[1] for r in sample], float), np.array([r[2] for r in sample], float)
    lines, parts = line_counts(texts), []
    for found in words(texts):
        bounds, number, value, statistics = vectors(found, lines[found.begin : found.end])
        for i in range(len(bounds) - 1):
            whole = np.array(sample[found.begin + i][3]) if len(sample[found.begin + i]) > 3 else statistics[i]
            parts.append((number[bounds[i] : bounds[i + 1]], value[bounds[i] : bounds[i + 1]], whole))
    table = np.array([p[2] for p in parts])
    centre, spread = table.mean(axis=0), table.std(axis=0) + 1e-3
    z = np.clip((table - centre) / spread, -8, 8)
    bias, w, v = np.log((y @ weight + 1) / ((1 - y) @ weight + 1)), start.linear.copy(), start.factors.copy()
    seen_w, seen_v = np.full_like(w, 1e-8), np.full_like(v, 1e-8)
    always = np.arange(BUCKETS, size)
    for _ in range(rounds):
        order = rng.permutation(len(parts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            number = np.concatenate([np.concatenate((parts[r][0], always)) for r in rows])
            value = np.concatenate([np.concatenate((parts[r][1], z[r])) for r in rows])
            bounds = np.concatenate(([0], np.cumsum([len(parts[r][0]) + STATISTICS for r in rows])))
            weighted = v[number] * value[:, None]
            sums = segment_sums(weighted, bounds)
            score = bias + segment_sums(w[number] * value, bounds) + 0.5 * (sums**2 - segment_sums(weighted**2, bounds)).sum(axis=1)
            error = (logistic(score) - y[rows]) * weight[rows] / weight[rows].sum()
            each = np.repeat(error, np.diff(bounds)) * value
            used, at = np.unique(number, return_inverse=True)
            gradient = np.bincount(at, each, len(used)) + penalty * w[used]
            seen_w[used] += gradient**2
            w[used] -= rate * gradient / np.sqrt(seen_w[used])
            pull = each[:, None] * (np.repeat(sums, np.diff(bounds), axis=0) - weighted)
            gradient = np.column_stack([np.bincount(at, pull[:, k], len(used)) for k in range(FACTORS)]) + penalty * v[used]
            seen_v[used] += gradient**2
            v[used] -= rate * gradient / np.sqrt(seen_v[used])
            bias -= rate * error.sum()
    return Model(bias, w, v, centre, spread)


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, seed: int = 5) -> Model:
    """Fit on a sample of the labelled documents that are not held out."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", label)
    counts = {r[label]: r["n"] for r in usable.groupBy(label).agg(F.count("*").alias("n")).collect()}
    # The sample is bounded by its parameters, so the few ids may be broadcast.
    ids = one_per_id(sampled_ids(usable, "doc_id", label, per_label, 2, seed), "doc_id")
    drawn = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    @F.arrow_udf("array<double>")
    def statistics_of(texts: pa.Array) -> pa.Array:
        return whole_statistics(texts)

    part = excerpt(F.col("text"), F.col("doc_id"), seed).alias("part")
    rows = one_per_id(drawn.select("doc_id", part, label, statistics_of(F.col("text")).alias("statistics")), "doc_id").collect()
    drawn = {y: sum(r[label] == y for r in rows) for y in (0, 1)}
    weights = {y: counts[y] / drawn[y] for y in (0, 1) if drawn[y]}
    return fit([(r["part"], r[label], weights[r[label]], r["statistics"]) for r in rows], seed)


def whole_statistics(texts: pa.Array) -> pa.Array:
    out, lines = np.zeros((len(texts), STATISTICS)), line_counts(texts)
    for found in words(texts):
        out[found.begin : found.end] = vectors(found, lines[found.begin : found.end])[3]
    return pa.array(list(out), pa.list_(pa.float64()))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    out, lines = np.zeros(len(texts)), line_counts(texts)
    for found in words(texts):
        bounds, number, value, statistics = vectors(found, lines[found.begin : found.end])
        z = np.clip((statistics - model.centre) / model.spread, -8, 8) * model.spread + model.centre
        out[found.begin : found.end] = raw_scores(model, bounds, number, value, z)
    return logistic(out)


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of its ``text``."""
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(Model(*shipped.value), texts))

    own = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*own, of(F.col("text").cast("string")).alias(name))


__all__ = ["Model", "fit", "fit_on", "score", "score_texts"]
