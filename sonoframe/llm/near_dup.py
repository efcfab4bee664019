"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``COLLECTION`` keys each are computed per document, a key being
``ROWS`` minima. Every pair of a key of the first and a key of the second collection is the key of one
table, so ``COLLECTION`` squared tables of ``2 ROWS`` minima cost only ``2 COLLECTION ROWS`` minima. A link of
similarity s is found with probability (1 - (1 - s^ROWS)^COLLECTION)^2: 0.9992 at 0.8, 0.999997 at 0.9.

1. One pass over the texts writes set sizes, a 128-bit fingerprint of each set and its minima.
2. Equal sets are one class from here on.
3. A key only one class has cannot be half of a shared table key. What is left is paired.
4. Tables often hold the same group of classes; each group is kept once.
5. In a group, documents that agree in ``LIKELY_PERCENT`` of their minima are linked. Components of these likely links
   are families; a passage that many documents share makes none. A link of 0.8 agrees so often but for 3 in 100,000.
6. Every document of a family is sent there once, with its full set of 64-bit shingle hashes, and
   links between any two documents of a family are confirmed on those.
7. Connected components of the confirmed links.

Groups and families are compared by pivots: a document against all others at once. Every document outside the
largest component so far is a pivot, so of any two documents that end in different components one
was compared with the other. Only links of a spanning forest are written. Beyond ``BLOCK`` documents, a group is cut
into blocks, and each two blocks are compared in a task of their own; no list of pairs is made.

Defined results: a document without words has no set, component ``doc_id`` and is kept; a null id is
never linked, its component is null and it is kept; repeated rows of an id each follow their own text;
an empty table gives an empty table.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sonoframe.llm.components import components
from sonoframe.llm.stored import stored
from sonoframe.llm.words import MULTIPLIER, mix, word_hashes, words

SHINGLE = 4
PERCENT = 80
COLLECTION = 11
ROWS = 3
LIKELY_PERCENT = 60
BLOCK = 256
SEED = 20_011

SIGNATURES = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, minima array<int>"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of every text's word shingles. A-Z are lower-cased first."""
    for found in words(pc.ascii_lower(texts)):
        hashes, bounds = word_hashes(found.distinct, 7)[found.codes], found.bounds.tolist()
        rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size):
            rolled = rolled * MULTIPLIER + hashes[k : k + len(rolled)]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = short * MULTIPLIER + h
                yield mix(np.array([short], np.uint64))
            else:
                yield rolled[:0]


def signatures(docs: DataFrame, size: int = SHINGLE, collection: int = COLLECTION, rows: int = ROWS) -> DataFrame:
    n = 2 * collection * rows
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = list(shingle_sets(batch.column("text"), size))
                sizes = np.array([len(s) for s in sets], np.int64)
                minima = np.zeros((len(sets), n), np.uint32)
                fingerprints = np.zeros((len(sets), 2), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for k in range(n):
                        minima[full, k] = mix(np.minimum.reduceat(flat * factors[k], starts)) >> np.uint64(32)
                    for j in range(2):
                        fingerprints[full, j] = np.add.reduceat(mix(flat + np.uint64(77 + j)), starts)
                columns = [batch.column("doc_id"), pa.array(sizes)]
                columns += [pa.array(fingerprints[:, j].view(np.int64)) for j in range(2)]
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n)
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(minima.view(np.int32).ravel())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fp1", "fp2", "minima"])

    return _id_and_text(docs).mapInArrow(sign, SIGNATURES)


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def candidate_groups(classes: DataFrame, collection: int, rows: int) -> DataFrame:
    """``(one, table_key, n, doc_id)``: groups of two or more classes with a table key in common, each distinct
    group once. ``one`` is the key's first half. ``classes`` has one row per class."""
    halves = [F.xxhash64(F.lit(k), F.slice("minima", k * rows + 1, rows)) for k in range(2 * collection)]
    classes = classes.select(
        "doc_id", "fp1", F.array(*halves[:collection]).alias("first"), F.array(*halves[collection:]).alias("second")
    )
    keys = classes.select("doc_id", "fp1", F.explode(F.concat("first", "second")).alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    # At most twice COLLECTION keys are in a list.
    left = keys.join(shared, "key", "left_semi").groupBy("doc_id", "fp1").agg(F.collect_set("key").alias("shared"))
    kept = classes.join(left, ["doc_id", "fp1"]).select(
        "doc_id", "fp1", F.array_intersect("first", "shared").alias("first"), F.array_intersect("second", "shared").alias("second")
    )
    kept = stored(kept.filter((F.size("first") > 0) & (F.size("second") > 0)), "half-keys")
    paired = kept.withColumn("one", F.explode("first")).withColumn("two", F.explode("second"))
    paired = paired.select("doc_id", "fp1", "one", F.xxhash64("one", "two").alias("table_key"))
    content = paired.groupBy("table_key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp1")).alias("x"), F.bit_xor(F.xxhash64("fp1", F.lit(1))).alias("y")
    )
    groups = content.filter("n > 1").groupBy("n", "x", "y").agg(F.min("table_key").alias("table_key"))
    chosen = stored(groups.select("table_key", "n"), "groups")
    return paired.join(chosen, "table_key").select("one", "table_key", "n", "doc_id")


class Forest:
    """Union-find over places."""

    def __init__(self, n: int) -> None:
        self.up, self.size = list(range(n)), [1] * n
        self.largest = 0  # the root of the largest tree

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            i, j = min(i, j), max(i, j)
            self.up[j] = i
            self.size[i] += self.size[j]
        if self.size[i] > self.size[self.root(self.largest)]:
            self.largest = i


def forest_of(n: int, linked: Callable[[int], np.ndarray]) -> list[int]:
    """For each place the first place of its component. ``linked`` gives the places linked to one."""
    forest, waiting, skipped = Forest(n), list(range(n)), []
    while waiting:
        for p in waiting:
            if forest.root(p) == forest.root(forest.largest) and forest.size[forest.root(p)] > 1:
                skipped.append(p)  # need not be a pivot while it is in the largest component
                continue
            for q in linked(p).tolist():
                forest.join(p, q)
        # Another component may have become the largest, in this pass or an earlier one.
        largest = forest.root(forest.largest)
        waiting = [p for p in skipped if forest.root(p) != largest]
        skipped = [p for p in skipped if forest.root(p) == largest]
    return [forest.root(i) for i in range(n)]


def alike_minima(rows: list[np.ndarray], percent: int) -> Callable[[int], np.ndarray]:
    table = np.stack(rows)
    return lambda p: np.flatnonzero(100 * (table == table[p]).sum(axis=1) >= percent * table.shape[1])


def alike_sets(rows: list[np.ndarray], percent: int) -> Callable[[int], np.ndarray]:
    sizes = np.array([len(s) for s in rows], np.int64)
    distinct, local = np.unique(np.concatenate(rows), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(distinct), bool)

    def linked(p: int) -> np.ndarray:
        own = local[starts[p] : starts[p] + sizes[p]]
        mark[own] = True
        common = np.add.reduceat(mark[local], starts, dtype=np.int64)
        mark[own] = False
        return np.flatnonzero(100 * common >= percent * (sizes + sizes[p] - common))

    return linked


def group_links(
    rows: DataFrame, home: list[str], group: str, values: str, alike: Callable[[list[np.ndarray], int], Callable[[int], np.ndarray]], percent: int,
    block: int,
) -> DataFrame:
    """Links ``(a, b)`` among the ``doc_id`` of each group of ``n`` rows, by their ``values``.

    Groups with the same ``home`` are compared by the same task, which writes only links that join what
    its links so far have not joined.
    """
    own, blocks = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.ceil(F.col("n") / block).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = [*home, "low", "high"]
    dealt = dealt.select(
        *dict.fromkeys([*home, group]), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", values
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key, ids, held, joined = None, None, [], [], {}

        def top(doc: int) -> int:
            while joined.get(doc, doc) != doc:
                doc = joined[doc]
            return doc

        def found() -> Iterator[pa.RecordBatch]:
            if len(ids) < 2:
                return
            pairs = []
            for i, r in enumerate(forest_of(len(ids), alike(held, percent))):
                a, b = top(ids[i]), top(ids[r])
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    pairs.append((ids[i], ids[r]))
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            lists = batch.column(values)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            where = list(zip(*(batch.column(c).to_pylist() for c in places), strict=True))
            groups, docs = batch.column(group).to_pylist(), batch.column("doc_id").to_pylist()
            for i, doc in enumerate(docs):
                if (where[i], groups[i]) != (place, key):
                    yield from found()
                    ids, held = [], []
                    if where[i] != place:
                        joined = {}
                    place, key = where[i], groups[i]
                ids.append(doc)
                held.append(flat[bounds[i] : bounds[i + 1]].copy())
        yield from found()

    return dealt.repartition(*places).sortWithinPartitions(*places, group, "doc_id").mapInArrow(link, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(doc_id, shingles)`` of the documents whose ids are in ``wanted``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"]
                )

    chosen = _id_and_text(docs).join(wanted, "doc_id", "left_semi")
    return chosen.mapInArrow(gather, "doc_id bigint, shingles array<bigint>")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, collection: int = COLLECTION, rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """For every row of ``(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``."""
    signed = stored(signatures(docs, size, collection, rows), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "minima")).alias("c")
    classes = stored(usable.groupBy("fp1", "fp2").agg(first).select("fp1", "fp2", "c.*"), "classes")

    groups = candidate_groups(classes, collection, rows).join(classes.select("doc_id", "minima"), "doc_id")
    likely = components(group_links(groups, ["one"], "table_key", "minima", alike_minima, LIKELY_PERCENT, block))
    likely = likely.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    members = stored(likely.union(likely.select("family", "family").distinct()), "family-members")
    families = stored(members.groupBy("family").agg(F.count("*").alias("n")), "families")

    sets = full_sets(docs, members.select("doc_id"), size)
    gathered = members.join(families, "family").join(sets, "doc_id")
    found = components(group_links(gathered, ["family"], "family", "shingles", alike_sets, percent, block))
    named = classes.select("fp1", "fp2", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = stored(named.select("fp1", "fp2", F.coalesce("component", "doc_id").alias("component_id")), "class-components")
    # Rows without a set or an id must not meet a class.
    keyed = signed.select(
        "doc_id", "n_shingles",
        *[F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("fp1", "fp2")],
    )
    found = keyed.join(named, ["fp1", "fp2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
