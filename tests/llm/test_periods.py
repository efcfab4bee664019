import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sonoframe.llm import periods
from sonoframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def online_runs(words, least_words=24, least_periods=3):
    """The plain form: for each word, its earlier occurrences lengthen the match of their lag."""
    places, active, found = {}, {}, []

    def close(end, lags):
        for lag in lags:
            match = active.pop(lag)
            if match + lag >= max(least_words, least_periods * lag):
                found.append((end - match - lag, match + lag, lag))

    for i, w in enumerate(words):
        lags = {i - j for j in places.get(w, [])}
        close(i, [lag for lag in active if lag not in lags])
        for lag in lags:
            active[lag] = active.get(lag, 0) + 1
        places.setdefault(w, []).append(i)
    close(len(words), list(active))

    def smallest(start, length, period):
        part = words[start : start + length]
        return not any(part[d:] == part[:-d] for d in range(1, period))

    return sorted((r for r in found if smallest(*r)), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_the_plain_form():
    rng = random.Random(11)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 12)):
                block = [rng.randint(0, rng.choice([0, 1, 4])) for _ in range(rng.randint(1, 14))]
                times = rng.choice([1, 1, 2, 3, 5])
                words += (block * times)[: len(block) * times - rng.randint(0, len(block) - 1)]
            docs.append(words)
        codes = np.array([w for d in docs for w in d], np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        least = rng.choice([3, 9, 24])
        found = periods.find_runs(codes, bounds, least)
        want = [(s + bounds[i], n, q) for i, d in enumerate(docs) for s, n, q in online_runs(d, least)]
        assert list(zip(*(part.tolist() for part in found), strict=True)) == want


def test_long_and_frequent_words_stay_cheap():
    rng = np.random.default_rng(2)
    codes = np.concatenate((np.zeros(200_000, np.int64), rng.integers(1, 4, 200_000), np.tile(rng.integers(0, 9, 700), 300)))
    found = periods.find_runs(codes, np.array([0, len(codes)]))
    assert (0, 200_000, 1) in set(zip(*(part.tolist() for part in found), strict=True))
    assert (int(found.length.max()), int(found.period[found.length.argmax()])) in [(210_000, 700), (210_001, 700), (210_002, 700)]


def test_fewer_than_three_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periods.periodic_runs(spark.createDataFrame([("a",)], "text string"), least_periods=2)


def test_odd_rows(spark):
    loop = " ".join(["x", "y z"] * 20)
    rows = [(1, None, "k"), (2, "", "k"), (3, " \t\n ", "k"), (4, f"a\n{loop}\x0bb", "k"), (4, f"a\n{loop}\x0bb", "k"), (None, loop, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    found = periods.periodic_runs(docs).collect()
    assert periods.periodic_runs(docs.limit(0)).collect() == []
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    # a run of x and y z also keeps the period up to the last word before b
    assert got == [
        (0, 40, [(0, 40, 2)], "x y z"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""),
        (4, 42, [(1, 40, 2)], "a x y z b"), (4, 42, [(1, 40, 2)], "a x y z b"),
    ]


def expected(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = online_runs(words)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha(listed), sha(collapsed(words, runs)))


def test_query_equals_the_plain_form(spark, tmp_path, docs):
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, "", " ", "one", "so so " * 40])], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = QUERIES["op11_periodic_runs"].build(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(expected(r.doc_id, r.text) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 5
