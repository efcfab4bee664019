"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product. One more coordinate makes all rows equally long, so the largest inner
product is the smallest distance, which p-stable hashes keep: floor((a x + b) / w) with Gaussian a.
``TABLES`` tables hold every distinct vector in a bucket of K such hashes. A query visits its own
bucket and then perturbed ones, in the order of their estimated success: a hash is moved to the
neighbouring cell whose border is near, and sets of moves are ranked by the expected squared
distances to those borders. The candidates of all tables are merged and scored exactly.

The number of probes is fitted: the exact neighbours of ``FIT_QUERIES`` queries are found over all rows,
and probes are added until the tables reach ``RECALL`` of them, or until they cost more than a scan. K grows with the
logarithm of the number of rows. Every row is indexed.

The fit holds on average only. After the search, the chance that a row as near as a query's last hit is in one of
its buckets is computed from the hashes. Queries with a chance under ``LEAST_CHANCE``, or with too few hits, are
compared with all rows instead, in blocks of queries and rows.

Equal vectors are one class: it is searched once, and each keeps its smallest ids, enough for any answer. A
query's best scores within a bounded sample of rows are a lower bound for its answer, below which no
candidate leaves a task. Buckets are dealt to groups of about ``GROUP_ROWS`` rows; larger groups are cut.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; ties go to the smaller id; a query with fewer candidates than ``k`` gets all of them;
an empty table gives an empty table.
"""

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sonoframe.llm.stored import stored

TABLES = 6
WIDTH = 2.0  # of a hash's cell, in lengths of the longest vector
FIRST_PROBES = 2048  # tried by the fit, then twice as many, and so on
RECALL = 0.94
LEAST_CHANCE = 0.9  # of finding a row as near as the last hit, below which a query is answered exactly
FIT_QUERIES = 96
SAMPLE_ROWS = 8192
SPARE = 5  # times k: so many rows should lie above a query's bound, as not all of them are found
GROUP_ROWS = 16_384
EXACT_QUERIES, EXACT_ROWS, EXACT_BLOCKS = 16_384, 65_536, 24  # of a block, and blocks of rows at least
SEED = 31


class Hashes(NamedTuple):
    directions: np.ndarray  # (tables, dimensions + 1, K)
    shifts: np.ndarray  # (tables, K), in cells
    mixers: np.ndarray  # (tables, K)
    longest: float

    def cells(self, table: int, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions[table] / (WIDTH * self.longest) + self.shifts[table]

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0))
        return np.column_stack((x, rest))

    def queries(self, x: np.ndarray) -> np.ndarray:
        scaled = x * (self.longest / np.sqrt((x**2).sum(axis=1)))[:, None]
        return np.column_stack((scaled, np.zeros(len(x))))

    def buckets(self, table: int, cells: np.ndarray) -> np.ndarray:
        return (np.floor(cells).astype(np.int64) * self.mixers[table]).sum(axis=1)


def make_hashes(dimensions: int, n_rows: int, longest: float, seed: int = SEED) -> Hashes:
    rng, k = np.random.default_rng(seed), max(4, round(np.log2(max(n_rows, 2)) / 2) + 1)
    return Hashes(
        rng.normal(size=(TABLES, dimensions + 1, k)), rng.uniform(size=(TABLES, k)),
        rng.integers(1, 1 << 62, (TABLES, k)) * 2 + 1, longest,
    )


def probing_order(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of moves in the order of expected success. A move is named by its rank among all ``2 k``
    borders sorted by distance; ranks j and 2 k - 1 - j are the two borders of one hash."""
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2))
    cost = np.concatenate((near, far[::-1]))
    found: list[tuple[int, ...]] = [()]
    queue = [(cost[0], (0,))]
    while queue and len(found) < most:
        total, moves = heapq.heappop(queue)
        if not any(2 * k - 1 - m in moves for m in moves):
            found.append(moves)
        last = moves[-1]
        if last + 1 < 2 * k:
            heapq.heappush(queue, (total - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(queue, (total + cost[last + 1], (*moves, last + 1)))
    return found


def probes(hashes: Hashes, table: int, vectors: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
    """Buckets to visit, (queries, probes), best first."""
    cells = hashes.cells(table, vectors)
    k = cells.shape[1]
    inside = cells - np.floor(cells)
    ranked = np.argsort(np.concatenate((inside, 1 - inside), axis=1), axis=1, kind="stable")
    step = np.concatenate((-hashes.mixers[table], hashes.mixers[table]))[ranked]
    return hashes.buckets(table, cells)[:, None] + step @ move_table(k, order).T


def move_table(k: int, order: list[tuple[int, ...]]) -> np.ndarray:
    chosen = np.zeros((len(order), 2 * k), np.int64)
    for i, moves in enumerate(order):
        chosen[i, list(moves)] = 1
    return chosen


def chances(hashes: Hashes, x: np.ndarray, scores: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
    """For each query the probability, over directions, that a row with this score lies in a probed bucket.

    Given a query's own hashes, those of a row at distance d are independent normals about them."""
    longest, lengths = hashes.longest, np.sqrt((x**2).sum(axis=1))
    far = np.clip(2 - 2 * scores / lengths / longest, 1e-12, 4 - 1e-12)[:, None]  # squared distance, in squared lengths
    spread = np.sqrt(far * (1 - far / 4)) / WIDTH
    normal, lifted, missed = np.frompyfunc(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), 1, 1), hashes.queries(x), np.ones(len(x))
    k = hashes.shifts.shape[1]
    chosen = move_table(k, order).T.astype(np.float64)
    for t in range(TABLES):
        cells = hashes.cells(t, lifted)
        inside, drift = cells - np.floor(cells), -far / 2 * (cells - hashes.shifts[t])
        edges = [normal((e - inside - drift) / spread).astype(np.float64) for e in (-1, 0, 1, 2)]
        down, stay, up = (np.log(np.maximum(b - a, 1e-300)) for a, b in zip(edges[:-1], edges[1:], strict=True))
        ranked = np.argsort(np.concatenate((inside, 1 - inside), axis=1), axis=1, kind="stable")
        moved = np.take_along_axis(np.concatenate((down - stay, up - stay), axis=1), ranked, axis=1)
        missed *= 1 - np.minimum(np.exp(moved @ chosen + stay.sum(axis=1)[:, None]).sum(axis=1), 1)
    return 1 - missed


def matrix(batch: pa.RecordBatch, name: str, dimensions: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def usable(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int, int, float]:
    """``(vec_id, vec)`` rows that take part, their dimensions and number, and the largest length."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(finite)
    rows = rows.withColumn("_square", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).filter("_square > 0 AND _square < double('Infinity')")
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max("_square").alias("m"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    d, n, m = (most["d"], most["n"], most["m"]) if most else (1, 0, 1.0)
    return rows.filter(F.size("vec") == d).select("vec_id", "vec"), d, n, float(np.sqrt(m))


def exact_best(classes: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> dict[int, list[np.ndarray]]:
    """The vectors of the k best classes for a few queries, over all classes."""
    n_dims = vectors.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, reps = matrix(batch, "vec", n_dims), batch.column("rep").to_numpy()
            scores = np.where(ids[:, None] == reps[None, :], -np.inf, vectors @ x.T)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(ids)), top.shape[1])
            at = top.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(-scores[q, at]), pa.array(reps[at]), pa.array(list(x[at]), pa.list_(pa.float64()))],
                names=["query", "cost", "rep", "vec"],
            )

    rows = classes.mapInArrow(best, "query bigint, cost double, rep bigint, vec array<double>")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("cost", "rep"))
    found: dict[int, list[np.ndarray]] = {}
    for row in rows.withColumn("rank", rank).filter(F.col("rank") <= k).filter("cost < double('Infinity')").select("query", "vec").collect():
        found.setdefault(row["query"], []).append(np.array(row["vec"]))
    return found


def fitted_order(hashes: Hashes, classes: DataFrame, queries: DataFrame, k: int, recall: float, n_rows: int) -> list[tuple[int, ...]]:
    """The probes that reach ``recall`` of the exact neighbours of a bounded number of queries. Where they would cost
    more than a scan, as many as cost a scan: queries they do not serve are answered exactly."""
    rows = queries.orderBy(F.xxhash64(F.lit(SEED), "rep")).limit(FIT_QUERIES).collect()
    size, most = hashes.shifts.shape[1], FIRST_PROBES
    if not rows:
        return probing_order(size, 1)
    ids, vectors = np.array([r["rep"] for r in rows]), np.array([r["vec"] for r in rows])
    truth = exact_best(classes, ids, vectors, k)
    known = [i for i, query in enumerate(ids.tolist()) if query in truth]
    if not known:
        return probing_order(size, 1)
    near = [hashes.rows(np.array(truth[ids[i]])) for i in known]
    while True:
        order = probing_order(size, most)
        needed = [np.full(len(x), len(order)) for x in near]
        for t in range(TABLES):
            visits = probes(hashes, t, hashes.queries(vectors[known]), order)
            for i, x in enumerate(near):
                hit = visits[i][None, :] == hashes.buckets(t, hashes.cells(t, x))[:, None]
                needed[i] = np.minimum(needed[i], np.where(hit.any(axis=1), hit.argmax(axis=1), len(order)))
        every = np.sort(np.concatenate(needed))
        enough = int(every[int(np.ceil(recall * len(every))) - 1]) + 1
        if enough <= len(order) or len(order) < most or TABLES * most >= n_rows:
            return order[:enough]
        most *= 2


def scanned(unsure: DataFrame, n_unsure: int, classes: DataFrame, n_rows: int, n_dims: int, n_best: int) -> DataFrame:
    """``(query, rep, score)`` with the ``n_best`` best classes of each query ``(rep, vec)``: every block of queries meets
    every block of classes in a task of its own. Queries of a block are held, classes pass by."""
    n_asked, n_given = -(-n_unsure // EXACT_QUERIES), max(EXACT_BLOCKS, -(-n_rows // EXACT_ROWS))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.lit(n)).cast("int")

    asks = unsure.select("rep", "vec", block(n_asked).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_given - 1))).alias("c"), F.lit(0).alias("given"))
    given = classes.select("rep", "vec", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("q"), block(n_given).alias("c"), F.lit(1).alias("given"))
    both = asks.unionByName(given).repartition("q", "c").sortWithinPartitions("q", "c", "given", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, best = None, [], []  # held: (ids, vectors); best: of each, places, ids and scores of the best so far

        def answers() -> Iterator[pa.RecordBatch]:
            for (ids, _), (i, reps, scores) in zip(held, best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(reps), pa.array(scores)], names=["query", "rep", "score"])

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("q", "c", "given")])
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
                if tuple(keys[a, :2]) != place:
                    yield from answers()
                    place, held, best = tuple(keys[a, :2]), [], []
                part = batch.slice(a, b - a)
                x, reps = matrix(part, "vec", n_dims), part.column("rep").to_numpy()
                for begin in range(0, len(x), 256):
                    if not keys[a, 2]:
                        held.append((reps[begin : begin + 256], x[begin : begin + 256]))
                        best.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
                if keys[a, 2]:
                    best = [merged(y, x, reps, so_far, n_best) for (_, y), so_far in zip(held, best, strict=True)]
        yield from answers()

    return both.mapInArrow(compare, "query bigint, rep bigint, score double")


def merged(y: np.ndarray, x: np.ndarray, reps: np.ndarray, so_far: tuple[np.ndarray, ...], n_best: int) -> tuple[np.ndarray, ...]:
    """The best so far of queries ``y``, and those of ``x``; equal scores by the smaller id."""
    scores = y @ x.T
    n = min(n_best, len(x))
    least = np.partition(scores, -n, axis=1)[:, -n]
    counts, ends = np.bincount(so_far[0], minlength=len(y)), np.cumsum(np.bincount(so_far[0], minlength=len(y)))
    full = counts == n_best
    least[full] = np.maximum(least[full], so_far[2][ends[full] - 1])
    # A little below, as blocks of another shape may round differently.
    i, j = np.nonzero(scores >= (least - 1e-9 * np.abs(least))[:, None])
    places, ids = np.concatenate((so_far[0], i)), np.concatenate((so_far[1], reps[j]))
    exact = np.concatenate((so_far[2], (y[i] * x[j]).sum(axis=1)))
    by = np.lexsort((ids, -exact, places))
    begins = np.searchsorted(places[by], np.arange(len(y)))
    by = by[np.arange(len(by)) - begins[places[by]] < n_best]
    return places[by], ids[by], exact[by]


def neighbours(
    df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every row for which ``is_query`` (over ``vec_id``) holds."""
    rows, n_dims, n_rows, longest = usable(df, vec_id, embedding)
    same = Window.partitionBy("vec").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("place", F.row_number().over(same)).withColumn("rep", F.min("vec_id").over(same))
    members = stored(ranked.filter(F.col("place") <= k + 1).select("rep", "place", "vec_id", "vec"), "vector-classes")
    classes = members.filter("place = 1").select("rep", "vec")
    asked = stored(rows.filter(is_query).join(classes, "vec").select("vec_id", "rep"), "queries")
    queries = stored(asked.select("rep").distinct().join(classes, "rep"), "query-classes")

    hashes = make_hashes(n_dims, n_rows, longest)
    order = fitted_order(hashes, classes, queries, k, recall, n_rows)
    sample = classes.orderBy(F.xxhash64(F.lit(SEED + 1), "rep")).limit(SAMPLE_ROWS).collect()
    known = np.array([r["rep"] for r in sample], np.int64), np.array([r["vec"] for r in sample], np.float64).reshape(-1, n_dims)
    # Plain data: what is broadcast is not pickled by value, and executors need not have this package.
    shared = df.sparkSession.sparkContext.broadcast((tuple(hashes), order, known))
    n_groups = max(1, -(-n_rows // GROUP_ROWS))
    # The place in the sample above which all rows hold at least k, and about SPARE k where they can.
    bound = max(k, -(-SPARE * k * len(sample) // max(1, n_rows)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hashes(*shared.value[0])
        for batch in batches:
            lifted = h.rows(matrix(batch, "vec", n_dims))
            for t in range(TABLES):
                bucket = h.buckets(t, h.cells(t, lifted))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(bucket), t, np.int32)), pa.array((bucket % n_groups).astype(np.int32)),
                        batch.column("rep"), batch.column("vec"), pa.array(bucket[:, None].tolist(), pa.list_(pa.int64())),
                        pa.nulls(len(bucket), pa.float64()),
                    ],
                    names=["table", "part", "rep", "vec", "buckets", "least"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, order, (known_ids, known_vectors) = shared.value
        h = Hashes(*plain)
        for batch in batches:
            size = max(1, min(1024, (1 << 21) // len(order)))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x, reps = matrix(part, "vec", n_dims), part.column("rep").to_numpy()
                least = np.full(len(x), -np.inf)
                if len(known_ids) > bound:
                    scores = np.where(reps[:, None] == known_ids[None, :], -np.inf, x @ known_vectors.T)
                    least = np.partition(scores, -bound, axis=1)[:, -bound]
                lifted = h.queries(x)
                for t in range(TABLES):
                    visits = probes(h, t, lifted, order)
                    for g in range(n_groups):
                        mine = visits % n_groups == g
                        q = np.flatnonzero(mine.any(axis=1))
                        if len(q):
                            lists = pa.ListArray.from_arrays(
                                pa.array(np.concatenate(([0], np.cumsum(mine[q].sum(axis=1)))).astype(np.int32)), pa.array(visits[q][mine[q]])
                            )
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(len(q), t, np.int32)), pa.array(np.full(len(q), g, np.int32)), pa.array(reps[q]),
                                    part.column("vec").take(pa.array(q)), lists, pa.array(least[q]),
                                ],
                                names=["table", "part", "rep", "vec", "buckets", "least"],
                            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, ready = None, [], None  # ready: buckets, vectors and ids of the group, sorted by bucket

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("table", "part", "piece")])
            asks = batch.column("least").is_valid().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
                if tuple(keys[a]) != place:
                    place, held, ready = tuple(keys[a]), [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((part.column("buckets").flatten().to_numpy(), matrix(part, "vec", n_dims), part.column("rep").to_numpy()))
                    continue
                if not held:
                    continue
                if ready is None:
                    bucket, x, reps = (np.concatenate(c) for c in zip(*held, strict=True))
                    by = np.argsort(bucket, kind="stable")
                    distinct, starts = np.unique(bucket[by], return_index=True)
                    ready = distinct, np.append(starts, len(by)), x[by], reps[by]
                yield from matches(part, *ready)

    def matches(part: pa.RecordBatch, distinct, starts, x, reps) -> Iterator[pa.RecordBatch]:
        lists = part.column("buckets")
        asked_for = lists.flatten().to_numpy()
        q = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(distinct, asked_for), len(distinct) - 1)
        known = distinct[at] == asked_for
        at, q = at[known], q[known]
        by = np.argsort(at, kind="stable")
        at, q = at[by], q[by]
        y, own, least = matrix(part, "vec", n_dims), part.column("rep").to_numpy(), part.column("least").to_numpy()
        rows_q, rows_x = [], []
        bounds = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(bounds.tolist(), [*bounds.tolist()[1:], len(at)], strict=True):
            begin, end = starts[at[a]], starts[at[a] + 1]
            # A little below the bound, as blocks of another shape may round differently.
            i, j = np.nonzero(y[q[a:b]] @ x[begin:end].T >= (least[q[a:b]] - 1e-9 * np.abs(least[q[a:b]]))[:, None])
            rows_q.append(q[a:b][i])
            rows_x.append(begin + j)
        if rows_q:
            i, j = np.concatenate(rows_q), np.concatenate(rows_x)
            score = (y[i] * x[j]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(reps[j]), pa.array(score)], names=["query", "rep", "score"])

    dealt = "table int, part int, rep bigint, vec array<double>, buckets array<bigint>, least double"
    indexed = classes.mapInArrow(index, dealt)
    sizes = stored(indexed.groupBy("table", "part").agg(F.ceil(F.count("*") / (2 * GROUP_ROWS)).cast("int").alias("pieces")), "group-sizes")
    placed = indexed.join(sizes, ["table", "part"]).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    probing = queries.mapInArrow(probe, dealt).join(sizes, ["table", "part"])
    probing = probing.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    both = placed.unionByName(probing).drop("pieces").repartition("table", "part", "piece")
    both = both.sortWithinPartitions("table", "part", "piece", F.col("least").isNotNull(), "rep")
    hits = both.mapInArrow(search, "query bigint, rep bigint, score double").groupBy("query", "rep").agg(F.max("score").alias("score"))

    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))

    def listed(hits: DataFrame) -> DataFrame:
        expanded = hits.withColumn("best", best).filter(F.col("best") <= k + 1).join(members.select("rep", "vec_id"), "rep")
        lists = expanded.withColumn("place", place).filter(F.col("place") <= k + 1)
        return lists.select(F.col("query").alias("rep"), "place", "vec_id", "score")

    def unsafe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, order = Hashes(*shared.value[0]), shared.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 21) // len(order))):
                part = batch.slice(at, max(1, (1 << 21) // len(order)))
                last = part.column("last").to_numpy(zero_copy_only=False).astype(np.float64)
                x, few = matrix(part, "vec", n_dims), ~np.isfinite(last)
                few[~few] = chances(h, x[~few], last[~few], order) < LEAST_CHANCE
                yield part.select(["rep", "vec"]).filter(pa.array(few))

    lists = stored(listed(hits), "nearest")
    last = lists.filter(F.col("place") == min(k + 1, n_rows)).select("rep", F.col("score").alias("last"))
    unsure = stored(queries.join(last, "rep", "left").mapInArrow(unsafe, "rep bigint, vec array<double>"), "unsure")
    n_unsure = unsure.count()
    if n_unsure:
        rest = listed(scanned(unsure, n_unsure, classes, n_rows, n_dims, k + 1))
        lists = stored(lists.join(unsure.select("rep"), "rep", "left_anti").unionByName(rest), "all-nearest")
    answers = asked.withColumnRenamed("vec_id", "query_id").join(lists, "rep").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
