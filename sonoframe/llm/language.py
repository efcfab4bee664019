"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a score per language from its affixes, its character n-grams and a
learned lexicon; learned transition scores join neighbouring words. Forward-backward turns them
into the probability of each language at each word, so text that switches language is labelled
word by word. A document's language is the one with the largest mean probability.

The model is fitted on the driver, on a bounded sample (``PER_LABEL`` documents of each language, fewer each beyond
``FULL_LABELS`` languages, at most ``MAX_TEXT_BYTES`` each). Training sequences splice runs of
words of different languages, which is what the transitions are learned from. The fitted model grows with the number of
labels only and is broadcast; whole texts are labelled where they are read, a slice at a time whose words times labels are
bounded. A long text is one chain: it is cut into blocks, each is reduced to one message product, and when these are
joined, all blocks step together.

Defined results: a null text or one without letters is ``und`` with score 0; ties go to the smaller
label; words without letters take no part; a table without usable labels gives ``und`` everywhere;
repeated rows get equal results.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sonoframe.llm.samples import excerpt, held_out, one_per_id, sampled_ids
from sonoframe.llm.words import Words, code_points, mix, word_hashes, words

PER_LABEL = 300
FULL_LABELS = 64
BUCKETS = 1 << 15
AFFIXES = (1, 2, 3, 4)
LEXICON_COUNT = 3  # uses of a word in the sample before the lexicon lists it
LEXICON_SHARE = 0.9  # of its uses that one language has
UNDETERMINED = "und"
SLICE_BYTES = 1 << 20  # of text labelled at once
SLICE_CELLS = 1 << 20  # words times labels of it, at about six bytes to a word; a single longer text is a slice of its own
BLOCK = 512  # words of a chain that are stepped through one by one


class Model(NamedTuple):
    labels: list[str]
    emissions: np.ndarray  # (BUCKETS + labels, labels); the last rows are the lexicon features
    transitions: np.ndarray
    lexicon: np.ndarray  # sorted hashes of listed words
    listed: np.ndarray  # their languages


def feature_groups(distinct: pa.Array, lexicon: np.ndarray, listed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and the words they belong to, one kind of feature after the other."""
    lowered = pc.utf8_lower(pc.replace_substring_regex(distinct, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    points, starts = code_points(lowered)
    lengths = np.diff(starts)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(points)) - np.repeat(starts[:-1], lengths)
    left = np.repeat(lengths, lengths) - place  # characters from here to the end of the word

    def numbered(hashes: np.ndarray, kind: int) -> np.ndarray:
        return (mix(hashes + np.uint64(kind * 1_000_003)) % np.uint64(BUCKETS)).astype(np.int64)

    gram = np.zeros(len(points), np.uint64)
    padded = np.concatenate((points, np.zeros(4, np.uint64)))
    for n in AFFIXES:
        gram = mix(gram * np.uint64(31) + padded[n - 1 : n - 1 + len(points)] + np.uint64(n))
        fits = left >= n
        if n <= 3:
            yield numbered(gram[fits], n), word[fits]
        start, end = fits & (place == 0), fits & (left == n)
        yield numbered(gram[start], 10 + n), word[start]
        yield numbered(gram[end], 20 + n), word[end]
    hashes = word_hashes(lowered)
    everyone = np.arange(len(lengths))
    yield numbered(hashes, 30), everyone
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = lexicon[at] == hashes
        yield BUCKETS + listed[at[known]], everyone[known]


def features(distinct: pa.Array, lexicon: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one word after the other, and the word of each."""
    numbers, owners = zip(*feature_groups(distinct, lexicon, listed), strict=True)
    number, owner = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return number[order], owner[order]


def distinct_scores(model: Model, distinct: pa.Array) -> np.ndarray:
    """The score of every label for every word, summed up kind by kind."""
    scores = np.zeros((len(distinct), len(model.labels)), np.float64)
    for number, owner in feature_groups(distinct, model.lexicon, model.listed):
        for k in range(scores.shape[1]):
            scores[:, k] += np.bincount(owner, model.emissions[number, k], len(distinct))
    return scores


def word_scores(model_emissions: np.ndarray, number: np.ndarray, owner: np.ndarray, n_words: int) -> np.ndarray:
    return np.column_stack(
        [np.bincount(owner, model_emissions[number, k], n_words) for k in range(model_emissions.shape[1])]
    )


def forward_backward(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Probabilities of every label at every place of every chain, and with ``pairs`` the expected
    number of each label pair. Chains step together; each step is scaled to sum 1."""
    n, n_labels = scores.shape
    begins, lengths = bounds[:-1], np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    factors = np.exp(scores - scores.max(axis=1, keepdims=True)) if n else scores
    step = np.exp(transitions)
    forward, message = np.zeros_like(factors), np.ones((len(lengths), n_labels))
    for t, k in enumerate(active.tolist()):
        at = begins[:k] + t
        m = (message[:k] @ step if t else message[:k]) * factors[at]
        message = m / m.sum(axis=1, keepdims=True)
        forward[at] = message
    marginals, counts = np.zeros_like(factors), np.zeros((n_labels, n_labels))
    message = np.ones((len(lengths), n_labels))
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        at = begins[:k] + t
        later = int(active[t + 1]) if t + 1 < len(active) else 0
        if later:
            onward = factors[begins[:later] + t + 1] * message[:later]
            if pairs:
                joint = forward[at[:later], :, None] * step * onward[:, None, :]
                counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            m = onward @ step.T
            message[:later] = m / m.sum(axis=1, keepdims=True)
        both = forward[at] * message[:k]
        marginals[at] = both / both.sum(axis=1, keepdims=True)
    return marginals, counts


def lettered(found: Words) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Only the words with a letter: their bounds, codes and distinct words."""
    has = pc.match_substring_regex(found.distinct, r"\p{L}").to_numpy(zero_copy_only=False)
    keep = has[found.codes]
    bounds = np.concatenate(([0], np.cumsum(keep)))[found.bounds]
    renumbered = np.cumsum(has) - 1
    return bounds, renumbered[found.codes[keep]], found.distinct.filter(pa.array(has))


def posteriors(factors: np.ndarray, bounds: np.ndarray, step: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Probabilities of every label at every place of every chain, as ``forward_backward`` gives them, with long chains in
    blocks. ``factors`` are exponentials of scores. Messages are in double precision; what is kept of them is not."""
    n_labels, lengths = factors.shape[1], np.diff(bounds)
    n_blocks = -(-lengths // block)
    chain = np.repeat(np.arange(len(lengths)), n_blocks)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begins = bounds[chain] + number * block
    sizes = np.minimum(block, bounds[chain + 1] - begins)
    before, after = np.ones((len(chain), n_labels)), np.ones((len(chain), n_labels))
    many = np.flatnonzero(n_blocks[chain] > 1)
    if len(many):
        _join_blocks(factors, begins[many], sizes[many], number[many] == 0, step, many, before, after)

    order = np.argsort(-sizes, kind="stable")
    begins, sizes, opens = begins[order], sizes[order], number[order] == 0
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right").tolist()
    out, message = np.empty(factors.shape, np.float32), before[order]
    for t, k in enumerate(active):
        at = begins[:k] + t
        onward = message[:k] @ step
        if t == 0:
            onward[opens] = message[opens]
        m = onward * factors[at]
        message = m / m.sum(axis=1, keepdims=True)
        out[at] = message
    message = after[order]
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        later = active[t + 1] if t + 1 < len(active) else 0
        if later:
            m = (factors[begins[:later] + t + 1] * message[:later]) @ step.T
            message[:later] = m / m.sum(axis=1, keepdims=True)
        at = begins[:k] + t
        both = out[at] * message[:k]
        out[at] = both / both.sum(axis=1, keepdims=True)
    return out


def _join_blocks(factors, begins, sizes, opens, step, places, before, after) -> None:
    """Fill in the messages at both ends of the blocks of long chains, from one product of messages per block."""
    n_labels = factors.shape[1]
    products = np.broadcast_to(np.eye(n_labels), (len(begins), n_labels, n_labels)).copy()
    for t in range(int(sizes.max())):
        here = np.flatnonzero(sizes > t)
        onward = products[here] @ step
        if t == 0:
            onward[opens[here]] = products[here][opens[here]]
        onward *= factors[begins[here] + t][:, None, :]
        products[here] = onward / onward.max(axis=(1, 2), keepdims=True)
    message = np.ones(n_labels)
    for i in range(len(begins)):
        message = np.ones(n_labels) if opens[i] else message
        before[places[i]] = message
        message = message @ products[i]
        message /= message.sum()
    for i in range(len(begins) - 1, -1, -1):
        last = i + 1 == len(begins) or opens[i + 1]
        message = np.ones(n_labels) if last else products[i + 1] @ message
        message = message / message.sum()
        after[places[i]] = message


def fit(sample: list[tuple[str, str]], seed: int = 3, rounds: int = 6, batch: int = 256, rate: float = 0.3) -> Model:
    """Learn from ``(text, label)`` rows by AdaGrad on the likelihood of spliced sequences."""
    sample = sorted(r for r in sample if r[0])
    labels = sorted({label for _, label in sample})
    empty = np.zeros(0, np.uint64)
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), empty, empty.astype(np.int64))
    rng, n_labels = np.random.default_rng(seed), len(labels)
    runs = []  # (codes of a run of words, label)
    found = list(words(pa.array([text for text, _ in sample])))
    distinct = pa.concat_arrays([f.distinct for f in found]).dictionary_encode()
    all_words, shift = distinct.dictionary, 0
    uses = np.zeros((len(all_words), n_labels))
    for f in found:
        bounds, codes, _ = lettered(f)
        to_all = distinct.indices.to_numpy()[shift : shift + len(f.distinct)].astype(np.int64)
        has = pc.match_substring_regex(f.distinct, r"\p{L}").to_numpy(zero_copy_only=False)
        place = to_all[has]
        shift += len(f.distinct)
        for i in range(len(bounds) - 1):
            y = labels.index(sample[f.begin + i][1])
            own = place[codes[bounds[i] : bounds[i + 1]]]
            np.add.at(uses, (own, y), 1)
            cut = 0
            while cut < len(own):
                n = int(rng.integers(3, 25))
                runs.append((own[cut : cut + n], y))
                cut += n
    hashes = word_hashes(pc.utf8_lower(pc.replace_substring_regex(all_words, r"^[^\p{L}]+|[^\p{L}]+$", "")))
    total, best = uses.sum(axis=1), uses.argmax(axis=1)
    sure = (total >= LEXICON_COUNT) & (uses.max(axis=1) >= LEXICON_SHARE * total)
    lexicon, first = np.unique(hashes[sure], return_index=True)
    listed = best[sure][first]
    number, owner = features(all_words, lexicon, listed)
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(all_words)))))

    emissions, transitions = np.zeros((BUCKETS + n_labels, n_labels)), np.zeros((n_labels, n_labels))
    seen_e, seen_t = np.full_like(emissions, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(rounds):
        # Runs in random order, four to a sequence: most neighbours differ in language at a seam only.
        rng.shuffle(runs)
        sequences = [runs[i : i + 4] for i in range(0, len(runs), 4)]
        for i in range(0, len(sequences), batch):
            group = sequences[i : i + batch]
            x = np.concatenate([r[0] for s in group for r in s])
            y = np.concatenate([np.full(len(r[0]), r[1]) for s in group for r in s])
            bounds = np.concatenate(([0], np.cumsum([sum(len(r[0]) for r in s) for s in group])))
            used, at = np.unique(x, return_inverse=True)
            lengths = starts[used + 1] - starts[used]
            pick = np.concatenate([np.arange(starts[u], starts[u + 1]) for u in used])
            own = np.repeat(np.arange(len(used)), lengths)
            scores = word_scores(emissions, number[pick], own, len(used))[at]
            marginals, expected = forward_backward(scores, bounds, transitions, pairs=True)
            marginals[np.arange(len(y)), y] -= 1
            inner = np.ones(len(y), bool)
            inner[bounds[1:] - 1] = False
            inner = np.flatnonzero(inner)
            np.add.at(expected, (y[inner], y[inner + 1]), -1)
            per_word = np.column_stack([np.bincount(at, marginals[:, k], len(used)) for k in range(n_labels)])
            gradient = np.column_stack(
                [np.bincount(number[pick], per_word[own, k], len(emissions)) for k in range(n_labels)]
            ) / len(group) + 1e-5 * emissions
            seen_e += gradient**2
            emissions -= rate * gradient / np.sqrt(seen_e)
            gradient = expected / len(group) + 1e-3 * transitions
            seen_t += gradient**2
            transitions -= rate * gradient / np.sqrt(seen_t)
    return Model(labels, emissions.astype(np.float32), transitions, lexicon, listed)


def fit_on(docs: DataFrame, per_label: int = PER_LABEL, seed: int = 3) -> Model:
    """Fit on a sample of the documents of ``(doc_id, text, lang)`` that are not held out."""
    usable = docs.filter(F.octet_length("text") > 0).withColumn("text", F.col("text").cast("string"))
    drawn = sampled_ids(usable, "doc_id", "lang", per_label, FULL_LABELS, seed)
    part = excerpt(F.col("text"), F.col("doc_id"), seed).alias("text")
    rows = one_per_id(drawn.select("doc_id", part, "lang"), "doc_id").collect()
    return fit([(r["text"], r["lang"]) for r in rows], seed)


def label_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every text the number of its language (-1: none), the score, and the share of
    words whose own best language differs from it."""
    return label_words(model, texts)[:3]


def label_words(model: Model, texts: pa.Array, certain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``label_texts``, and if it is asked for the mean of each word's largest probability."""
    best, score, mixed, sure = (np.zeros(len(texts), t) for t in (np.int64, np.float64, np.float64, np.float64))
    best[:] = -1
    if not model.labels:
        return best, score, mixed, sure
    step, n_labels = np.exp(model.transitions), len(model.labels)
    for found in words(texts, min(SLICE_BYTES, 6 * SLICE_CELLS // n_labels)):
        bounds, codes, distinct = lettered(found)
        if not len(codes):
            continue
        scores = distinct_scores(model, distinct)
        scores -= scores.max(axis=1, keepdims=True)
        marginals = posteriors(np.exp(scores).astype(np.float32)[codes], bounds, step)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        starts, n = bounds[some], n[some]
        means = np.add.reduceat(marginals, starts, axis=0, dtype=np.float64) / n[:, None]
        top = means.round(9).argmax(axis=1)
        other = marginals.argmax(axis=1) != np.repeat(top, n)
        at = found.begin + some
        best[at] = top
        score[at] = np.clip(means[np.arange(len(n)), top], 0, 1)
        mixed[at] = np.add.reduceat(other, starts, dtype=np.int64) / n
        if certain:
            sure[at] = np.clip(np.add.reduceat(marginals.max(axis=1), starts, dtype=np.float64) / n, 0, 1)
    return best, score, mixed, sure


def identify(docs: DataFrame, model: Model, certain: str | None = None) -> DataFrame:
    """``(doc_id, text)`` rows, and further columns, with ``lang_pred``, ``lang_score`` and ``switched``,
    the share of words in another language. ``certain`` names a column for the mean of each word's largest probability."""
    own = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "lang_score", "switched", (certain or "").lower())]
    docs = docs.select(*[f.name for f in own])
    # Plain data: what is broadcast is not pickled by value, and executors need not have this package.
    shipped, asked = docs.sparkSession.sparkContext.broadcast(tuple(model)), certain is not None

    @F.arrow_udf("struct<pred string, score double, switched double, certain double>")
    def predict(texts: pa.Array) -> pa.Array:
        m = Model(*shipped.value)
        best, score, switched, sure = label_words(m, texts, asked)
        names = pa.array([*m.labels, UNDETERMINED]).take(pa.array(np.where(best < 0, len(m.labels), best)))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(switched), pa.array(sure)], ["pred", "score", "switched", "certain"])

    found = docs.withColumn("_found", predict(F.col("text").cast("string")))
    names = [f.name for f in own]
    return found.select(
        *names, F.col("_found.pred").alias("lang_pred"), F.col("_found.score").alias("lang_score"),
        F.col("_found.switched").alias("switched"), *([F.col("_found.certain").alias(certain)] if certain else []),
    )


__all__ = ["Model", "fit", "fit_on", "held_out", "identify", "label_texts"]
