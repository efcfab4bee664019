"""Toxicity by a classifier with counterfactual regularisation.

A text is as toxic as its three worst sentences (of at most ``SENTENCE_WORDS`` words each). A sentence has a weight for each word, for the
beginnings and ends of words, which carry an insult through its inflected forms, and for each pair
of neighbouring words, in a learned lexicon; the ``WORST`` largest sums go through a logistic function together. Insults are thus not diluted
by the length of a text.

The fit is a logistic regression on the worst sentences of labelled documents, told anew in each round. For every sentence of the sample that mentions a group
of people, counterfactual sentences are made in which each term is swapped for another one of its kind, or for a word that says
nothing, and the squared change of the score is penalised. What the sample happens to say along with one group does then not become the
weight of that group's name, and neutral mentions of it are no false positives.

The model is fitted on the driver, on a bounded sample (``PER_LABEL`` documents of either label, at most
``samples.MAX_TEXT_BYTES`` each), weighted back to the shares of the labels it may learn from. It is broadcast as plain arrays, no larger than the sample's
lexicon; whole texts are scored where they are read.

Defined results: a null text and one without words get the score of a sentence without known words; without usable
labels every score is 0.5; equal rows get equal scores; an id with several texts or labels is learned from once (its least text
and label); an empty table gives an empty table; a column named like the score is replaced.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sonoframe.llm.samples import excerpt, one_per_id, sampled_ids
from sonoframe.llm.words import MULTIPLIER, Words, code_points, mix, words

PER_LABEL = 1500
SENTENCE_WORDS = 40
WORST = 3
SWAPS = 3  # counterfactuals of a sentence, the first of them without any group
FAIRNESS = 20.0  # weight of the squared change of a score under a swap
SUPPORT = 1.0  # documents' worth of evidence below which a weight stays zero
DECAY = 1e-5
AFFIXES = (3, 4, 5, 6)  # characters
LEAST_DOCUMENTS = 2  # of the sample that a word or pair must stand in
SMOOTHING = 10.0

# Terms that name groups of people, by kind. Terms of one kind are swapped for one another.
IDENTITY_TERMS = {
    "religion": "muslim muslims christian christians jewish jews jew hindu hindus buddhist buddhists catholic protestant sikh atheist atheists",
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer",
    "origin": "black white asian african european american arab latino mexican chinese indian russian turkish polish foreigner immigrant immigrants refugee refugees",
    "ability": "deaf blind disabled autistic elderly young old",
    "religion, German": "muslim muslime christ christen jude juden hindu buddhist katholik atheist",
    "gender, German": "frau frauen mann männer mädchen junge jungen",
    "origin, German": "deutscher deutsche türke türken pole polen ausländer flüchtling flüchtlinge migrant migranten",
    "religion, French": "musulman musulmans chrétien chrétiens juif juifs hindou bouddhiste catholique athée",
    "gender, French": "femme femmes homme hommes fille filles garçon garçons",
    "origin, French": "français arabe africain étranger étrangers immigré immigrés réfugié réfugiés",
    "religion, Spanish": "musulmán musulmanes cristiano cristianos judío judíos hindú budista católico ateo",
    "gender, Spanish": "mujer mujeres hombre hombres niña niñas niño niños",
    "origin, Spanish": "español árabe africano extranjero extranjeros inmigrante inmigrantes refugiado refugiados",
}


class Model(NamedTuple):
    bias: float
    lexicon: np.ndarray  # sorted hashes of words, affixes and pairs
    weights: np.ndarray  # one more than the lexicon: the last, 0, is of everything unknown


class Sentences(NamedTuple):
    codes: np.ndarray  # of all words
    first: np.ndarray  # whether a word begins a sentence
    document: np.ndarray  # of each sentence


def held_out(record_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(record_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def form_hashes(distinct: pa.Array) -> np.ndarray:
    """Of every word, in lower case and without marks at either end, the hash of itself, its beginnings and its ends;
    0 where there is none. All are differences of one running polynomial over the characters."""
    lowered = pc.utf8_lower(pc.replace_substring_regex(distinct, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    points, starts = code_points(lowered)
    begins, ends, lengths = starts[:-1], starts[1:], np.diff(starts)
    longest = int(lengths.max()) if len(lengths) else 0
    base = int(MULTIPLIER) | 1
    powers = np.cumprod(np.full(longest + 1, base, np.uint64))
    back = np.cumprod(np.full(longest + 1, pow(base, -1, 1 << 64), np.uint64))
    place = np.arange(len(points)) - np.repeat(begins, lengths)
    running = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points + np.uint64(7)) * powers[place], out=running[1:])
    columns = [np.where(lengths > 0, mix(running[ends] - running[begins] + lengths.astype(np.uint64)), np.uint64(0))]
    for n in AFFIXES:
        has = np.flatnonzero(lengths > n)
        for kind, a, b, first in ((1, begins[has], begins[has] + n, None), (2, ends[has] - n, ends[has], lengths[has] - n)):
            part = running[b] - running[a]
            if first is not None:
                part = part * back[first - 1]
            column = np.zeros(len(lengths), np.uint64)
            column[has] = mix(part + np.uint64(1_000_003 * (10 * n + kind)))
            columns.append(column)
    return np.column_stack(columns)


def sentences(found: Words) -> Sentences:
    n = len(found.codes)
    ends = pc.match_substring_regex(found.distinct, r"[.!?…。！？؟।]['\")\]»”’]*$").to_numpy(zero_copy_only=False)
    first = np.zeros(n, bool)
    first[1:] = ends[found.codes[:-1]]
    first[found.bounds[:-1][np.diff(found.bounds) > 0]] = True
    place = np.arange(n)
    first |= (place - np.maximum.accumulate(np.where(first, place, 0))) % SENTENCE_WORDS == 0
    document = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))[first]
    return Sentences(found.codes, first, document)


def pair_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each word with the next one in its sentence; 0 where there is none."""
    pairs = np.zeros(len(hashes), np.uint64)
    pairs[:-1] = mix(hashes[:-1] * MULTIPLIER + hashes[1:])
    pairs[:-1][first[1:] | (hashes[:-1] == 0) | (hashes[1:] == 0)] = 0
    return pairs


def looked_up(model: Model, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(model.lexicon, hashes)
    at[at == len(model.lexicon)] = 0
    known = model.lexicon[at] == hashes if len(model.lexicon) else np.zeros(len(hashes), bool)
    return model.weights[np.where(known, at, len(model.lexicon))]


def worst_sentences(total: np.ndarray, document: np.ndarray) -> np.ndarray:
    """The worst sentence of each document, and up to ``WORST - 1`` more with a positive total."""
    order = np.lexsort((-total, document))
    begins = np.append(True, document[1:] != document[:-1])
    place = np.arange(len(order))
    rank = place - np.maximum.accumulate(np.where(begins, place, 0))
    return order[(rank == 0) | ((rank < WORST) & (total[order] > 0))]


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of every text that it is toxic."""
    out = np.full(len(texts), float(model.bias))
    for found in words(texts, 4 << 20):
        cut = sentences(found)
        if not len(cut.document):
            continue
        forms = form_hashes(found.distinct)
        own = looked_up(model, forms.ravel()).reshape(forms.shape).sum(axis=1)
        weight = own[cut.codes] + looked_up(model, pair_hashes(forms[cut.codes, 0], cut.first))
        total = np.add.reduceat(weight, np.flatnonzero(cut.first))
        worst = worst_sentences(total, cut.document)
        out[found.begin : found.end] += np.bincount(cut.document[worst], total[worst], found.end - found.begin)
    return logistic(out)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def placed(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the lexicon; its length for what it does not list."""
    at = np.searchsorted(lexicon, hashes)
    inside = np.minimum(at, len(lexicon) - 1)
    return np.where(lexicon[inside] == hashes, inside, len(lexicon)).astype(np.int32) if len(lexicon) else at


def swapped(cut: Sentences, kinds: list[np.ndarray], of_form: np.ndarray, nobody: int, swaps: int, seed: int) -> tuple[Sentences, np.ndarray]:
    """Counterfactuals of the sentences that mention a group, and the sentence each is made from. ``kinds`` are lists of
    codes of terms, ``of_form`` the term each code is a form of, or -1. Once all terms become the code ``nobody``; otherwise those of a
    kind are exchanged by a rotation of its list, so equal terms of a sentence become equal terms."""
    rng = np.random.default_rng(seed)
    terms, sentence = of_form[cut.codes], np.cumsum(cut.first) - 1
    mentions = np.unique(sentence[terms >= 0])
    chosen = np.isin(sentence, mentions)
    terms, at, first = terms[chosen], sentence[chosen], cut.first[chosen]
    parts = []
    for swap in range(swaps if len(mentions) else 0):
        codes = cut.codes[chosen]
        if swap == 0:
            codes[terms >= 0] = nobody
        for kind in kinds if swap else ():
            here = np.isin(terms, kind)
            turn = rng.integers(1, len(kind), len(cut.document))[at[here]]
            codes[here] = kind[(np.searchsorted(kind, terms[here]) + turn) % len(kind)]
        parts.append(codes)
    if not parts:
        return Sentences(cut.codes[:0], cut.first[:0], cut.document[:0]), mentions
    swaps = len(parts)
    return Sentences(np.concatenate(parts), np.tile(first, swaps), np.tile(cut.document[mentions], swaps)), np.tile(mentions, swaps)


def fit(
    sample: list[tuple[str, int, float]], identity_terms: dict[str, str] | None = None, fairness: float = FAIRNESS,
    seed: int = 13, rounds: int = 120, rate: float = 0.3,
) -> Model:
    """Learn from ``(text, label, weight)`` rows by AdaGrad."""
    unknown = Model(0.0, np.zeros(0, np.uint64), np.zeros(1))
    sample = sorted(sample, key=lambda r: (r[0] or "", r[1]))
    if not sample:
        return unknown
    y, weight = np.array([r[1] for r in sample], float), np.array([r[2] for r in sample], float)
    weight /= weight.sum()
    bias = float(np.log((y @ weight + 1e-3) / ((1 - y) @ weight + 1e-3)))
    found = list(words(pa.array([r[0] for r in sample], pa.string())))
    terms = [sorted(set(group.split())) for group in (IDENTITY_TERMS if identity_terms is None else identity_terms).values()]
    listed = [t for group in terms for t in group]
    every = pa.concat_arrays([*[f.distinct for f in found], pa.array([*listed, ""], pa.string())]).dictionary_encode()
    to_all, shift, cuts = every.indices.to_numpy().astype(np.int64), 0, []
    for f in found:
        cut = sentences(f)
        cuts.append(cut._replace(codes=to_all[shift + cut.codes], document=cut.document + f.begin))
        shift += len(f.distinct)
    cut = Sentences(*(np.concatenate(part) for part in zip(*cuts, strict=True)))
    if not len(cut.document):
        return unknown._replace(bias=bias)
    forms, kinds = form_hashes(every.dictionary), []
    for group in terms:
        kinds.append(np.unique(to_all[shift : shift + len(group)]))
        shift += len(group)
    kinds = [kind for kind in kinds if len(kind) > 1]
    known = np.unique(np.concatenate(kinds)) if kinds else np.zeros(0, np.int64)
    by_hash = {int(forms[code, 0]): code for code in known}
    of_form = np.array([by_hash.get(int(h), -1) for h in forms[:, 0]], np.int64)
    other, origin = swapped(cut, kinds, of_form, int(to_all[-1]), SWAPS, seed)
    pairs, other_pairs = (pair_hashes(forms[c.codes, 0], c.first) for c in (cut, other))

    # In how many documents of either label each feature stands; one kind of feature after the other, as memory is the driver's.
    sentence = np.cumsum(cut.first) - 1
    document = cut.document[sentence]
    by_form = np.unique(document * len(forms) + cut.codes)
    holder, form = by_form // len(forms), by_form % len(forms)
    counted = [_document_counts(holder, forms[form, k], y) for k in range(forms.shape[1])]
    counted.append(_document_counts(document, pairs, y))
    del by_form, holder, form, document
    names, toxic, clean = (np.concatenate(part) for part in zip(*counted, strict=True))
    order = np.argsort(names, kind="stable")
    names, toxic, clean = names[order], toxic[order], clean[order]
    # The lexicon: what stands in enough documents, and all that a swap could change.
    mentions = np.isin(sentence, origin)
    changed = np.concatenate((forms[known].ravel(), other_pairs, pairs[mentions])) if len(origin) else pairs[:0]
    wanted = toxic + clean >= LEAST_DOCUMENTS
    lexicon = np.unique(np.concatenate((names[wanted], changed[changed != 0])))
    if not len(lexicon):
        return unknown._replace(bias=bias)
    # Start from damped log odds of the documents a feature stands in, which tells first worst sentences.
    share = (y.sum() + 1) / (len(y) + 2)
    odds = np.log((toxic + SMOOTHING * share) * (1 - share) / ((clean + SMOOTHING * (1 - share)) * share))
    w = np.zeros(len(lexicon))
    w[np.searchsorted(lexicon, names[wanted])] = 0.5 * odds[wanted]

    of_forms = [placed(lexicon, forms[:, k]) for k in range(forms.shape[1])]
    (of_pairs, starts), (other_of_pairs, other_starts) = (
        (placed(lexicon, p), np.flatnonzero(c.first)) for p, c in ((pairs, cut), (other_pairs, other))
    )
    ends = np.append(starts[1:], len(cut.codes))

    def totals(codes: np.ndarray, pair: np.ndarray, begin: np.ndarray) -> np.ndarray:
        known_or_0, own = np.append(w, 0.0), np.zeros(len(forms))
        for column in of_forms:
            own += known_or_0[column]
        return np.add.reduceat(own[codes] + known_or_0[pair], begin) if len(begin) else np.zeros(0)

    def sums(codes: np.ndarray, pair: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The sum of the words' values for every feature."""
        per_form, out = np.bincount(codes, value, len(forms)), np.bincount(pair, value, len(w) + 1)
        for column in of_forms:
            out += np.bincount(column, per_form, len(w) + 1)
        return out[:-1]

    support = SUPPORT * weight.min()
    inside = np.flatnonzero(mentions)
    other_sentence = np.cumsum(other.first) - 1
    seen_w, seen_b = np.full(len(lexicon), 1e-8), 1e-8
    for _ in range(rounds):
        total = totals(cut.codes, of_pairs, starts)
        worst = worst_sentences(total, cut.document)
        best = bias + np.bincount(cut.document[worst], total[worst], len(y))
        error = ((logistic(best) - y) * weight)[cut.document[worst]]
        length = ends[worst] - starts[worst]
        picked = np.repeat(starts[worst] - np.cumsum(length) + length, length) + np.arange(length.sum())
        gradient = sums(cut.codes[picked], of_pairs[picked], np.repeat(error, length)) + DECAY * w
        if len(origin):
            change = 2 * fairness / len(origin) * (total[origin] - totals(other.codes, other_of_pairs, other_starts))
            both = np.bincount(origin, change, len(total))
            gradient += sums(cut.codes[inside], of_pairs[inside], both[sentence[inside]])
            gradient -= sums(other.codes, other_of_pairs, change[other_sentence])
        seen_w += gradient**2
        pace = rate / np.sqrt(seen_w)
        w -= pace * gradient
        # What too few documents speak for shrinks to nothing, so rare words are not learned by heart.
        w = np.sign(w) * np.maximum(np.abs(w) - pace * support, 0)
        step = ((logistic(best) - y) * weight).sum()
        seen_b += step**2
        bias -= rate * step / np.sqrt(seen_b)
    used = w != 0
    return Model(float(bias), lexicon[used], np.append(w[used], 0.0))


def _document_counts(document: np.ndarray, hashes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every hash but 0, and in how many toxic and clean documents it stands."""
    document, hashes = document[hashes != 0], hashes[hashes != 0]
    names, number = np.unique(hashes, return_inverse=True)
    stands = np.unique(document * len(names) + number)
    label = y[stands // max(1, len(names))]
    number = stands % max(1, len(names))
    return names, np.bincount(number, label, len(names)), np.bincount(number, 1 - label, len(names))


def fit_on(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL,
    identity_terms: dict[str, str] | None = None, seed: int = 13,
) -> Model:
    """Fit on a sample of the labelled documents that are not held out."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    ids = one_per_id(sampled_ids(usable, "doc_id", "y", per_label, 2, seed, held_out), "doc_id")
    # The sample is bounded by its parameters, so the few ids may be broadcast, and one row of each is sent to the driver.
    part = excerpt(F.col("text").cast("string"), F.col("doc_id"), seed).alias("part")
    drawn = docs.select("doc_id", part).join(F.broadcast(ids), "doc_id")
    rows = one_per_id(drawn, "doc_id").collect()
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    found = {y: sum(r["y"] == y for r in rows) for y in counts}
    return fit([(r["part"], r["y"], counts[r["y"]] / found[r["y"]]) for r in rows], identity_terms, seed=seed)


def score(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """``docs`` with the score of its ``text``."""
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(Model(*shipped.value), texts))

    own = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*own, of(F.col("text").cast("string")).alias(name))
