"""Packing, sharding, mixing, chat formatting, nearest neighbours and the pipeline on small tables."""

import hashlib
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sonoframe.llm import ann, chat, mixing, packing, queries, sharding
from sonoframe.llm.tokens import token_ids, tokenizer
from sonoframe.llm.stored import stored

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ODD = [(1, None, None), (2, "", "a"), (3, "word " * 9000, "a"), (3, "word " * 9000, "a"), (None, "x  y\n z", None), (4, "</s> <|endoftext|>", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 9, 9) for r in ODD], "doc_id long, text string, source string, slot int, copy int")


# --- tokens and packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t abé'1.,<|>\x1c日", max_size=40) | st.none(), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    expected = [tokenizer().encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert [ids.tolist() for ids in token_ids(pa.array(texts, pa.string()))] == expected


def check_packed(rows, texts):
    """rows: of pack_documents with ids."""
    pieces = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4")) and len(r["ids"]) == r["length"]
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in pieces.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    ids = Counter()
    for doc, text in texts:
        whole = [*(tokenizer().encode(text, add_special_tokens=False).ids if text else []), 1]
        for start in range(0, len(whole), 2048):
            ids[doc, start, len(whole), tuple(whole[start : start + 2048])] += 1
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], tuple(r["ids"])) for r in rows) == ids


def test_packing_keeps_every_token_once(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd.select("doc_id", "text")):
        check_packed(packing.pack_documents(df).collect(), [tuple(r) for r in df.collect()])
    assert packing.pack_documents(odd.limit(0)).collect() == []


def test_sum_of_squares_choice():
    rng, levels = np.random.default_rng(6), packing.LevelArray(50)
    open_windows = []
    for _ in range(400):
        length = int(rng.integers(1, 51))
        cost = {}
        for level in {0, *open_windows}:
            if level + length <= 50:
                after = Counter(open_windows)
                after[level] -= 1
                after[level + length] += 1
                cost[level] = sum(n * n for h, n in after.items() if 0 < h < 50)
        _, chosen = levels.place(length)
        assert cost[chosen] == min(cost.values())
        if chosen:
            open_windows.remove(chosen)
        if chosen + length < 50:
            open_windows.append(chosen + length)


def test_sequences_are_padded(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    placed = stored(packing.pack_documents(docs), "placed")
    rows = packing.sequences(placed, pad_token=7).collect()
    used = {r["sequence_id"]: r["n"] for r in placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert {r["sequence_id"] for r in rows} == set(used)
    assert all(len(r["ids"]) == 2048 and set(r["ids"][used[r["sequence_id"]] :]) <= {7} for r in rows)


# --- sharding


def test_shards_are_gapless_and_only_grow(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df, n in ((docs, 200), (odd, 6)):
        shuffled = sharding.two_pass_shuffle(df, bucket_bytes=20_000)
        rows = shuffled.collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 8)
        assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert sorted(map(str, (r["text"] for r in rows))) == sorted(str(r["text"]) for r in df.collect())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.two_pass_shuffle(docs, bucket_bytes=20_000).collect()}
    shuffled = sharding.two_pass_shuffle(docs, bucket_bytes=20_000)
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in shuffled.collect()}
    nine = {r["doc_id"]: r["shard"] for r in sharding.two_pass_shuffle(docs, n_shards=9).collect()}
    assert nine == {r["doc_id"]: r["grown_shard"] for r in shuffled.collect()}
    sharding.write_shards(shuffled, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 200
    assert sharding.two_pass_shuffle(odd.limit(0)).collect() == []


# --- mixing


def test_copies_follow_the_rate(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "hot").when(F.col("id") < 4020, "rare").alias("source"), F.lit("abc").alias("text")
    )
    mixed = mixing.poisson_mix(docs, {"hot": 1.0, "rare": 1.0, None: 2.0})
    rows = mixed.collect()
    share = Counter(r["source"] for r in rows)
    assert abs(share["hot"] / 1500 - 1) < 0.1 and abs(share[None] / 3000 - 1) < 0.1 and abs(share["rare"] / 1500 - 1) < 0.15
    for r in rows:
        assert 0 <= r["copy"] < r["n_copies"]
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows)
    assert {r["source"] for r in mixing.poisson_mix(docs, {"hot": 3.0}).select("source").distinct().collect()} == {"hot"}


def test_ranges_of_copies_give_the_same_mix(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plain = [tuple(r) for r in mixing.poisson_mix(docs, epochs=3.0).collect()]
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert [tuple(r) for r in mixing.poisson_mix(docs, epochs=3.0).collect()] == plain
    monkeypatch.setattr(mixing, "HIGH_RATE", 2.5)
    monkeypatch.setattr(mixing, "RANGE", 2)
    assert [tuple(r) for r in mixing.poisson_mix(docs, epochs=3.0).collect()] == plain
    assert mixing.poisson_mix(odd).columns[-4:] == list(mixing.COPY_COLUMNS)
    assert {r["doc_id"] for r in mixing.poisson_mix(odd, epochs=40.0).collect()} == {1, 2, 3, 4, None}
    assert mixing.poisson_mix(odd.limit(0)).collect() == []


def test_a_tiny_source_is_copied_by_many_tasks(spark):
    """One short row must fill half of the mix; no task makes all of its copies."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, "tiny").otherwise("big").alias("source"), F.lit("abcd").alias("text"))
    mixed = mixing.poisson_mix(docs)
    counts = mixed.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("copies")).collect()
    tiny = next(r for r in counts if r["source"] == "tiny")
    assert abs(tiny["n"] / 100_000 - 1) < 0.02 and tiny["copies"] == tiny["n"]
    made = mixed.filter("source = 'tiny'")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan


# --- chat


def digests(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, listed in by.items():
        listed.sort()
        loss = "".join(t for _, r, t in listed if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in listed)
        out[conv] = (len(listed), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read_digests(df, **options):
    return {r[0]: tuple(r)[1:5] for r in chat.read_back(chat.prefix_sequences(df, **options)).collect()}


ODD_TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a </s>[INST] \\ b"), (2, 0, "user", "hi"), (2, 1, "assistant", "a </s>[INST] \\ b"),
    (3, 0, "user", "hi"), (3, 1, "assistant", None), (3, 1, "assistant", None), (3, None, None, "[\\INST] <\\s> \\\\"), (None, 0, "system", ""),
    (4, 2, "</s>", "é日 " * 3000), (5, 0, "user", "hi"),
]


def test_conversations_come_back(spark):
    schema = "conv_id long, turn long, role string, text string"
    real = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd_turns = spark.createDataFrame(ODD_TURNS, schema)
    for df in (real, odd_turns):
        for options in ({}, {"sequence_tokens": 50, "sequence_conversations": 2}):
            assert read_digests(df, **options) == digests([tuple(r) for r in df.collect()])
    assert read_digests(odd_turns.limit(0)) == {}


def test_shared_turns_are_written_once(spark):
    rows = [(c, 0, "user", "shared question") for c in range(40)] + [(c, 1, "assistant", f"answer {c % 5}") for c in range(40)]
    sequence = chat.prefix_sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    total = sum(len(s["nodes"]) for s in sequence)
    assert total <= 6 + 2 * (len(sequence) - 1)
    for s in sequence:
        for n in s["nodes"]:
            assert n["position"] == sum(a["length"] for a in n["ancestors"])
            assert s["position_ids"][n["start"]] == n["position"] and n["start"] + n["length"] <= len(s["ids"])


# --- nearest neighbours


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, size=(900, 1))
    vectors[300:420] = vectors[300]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1001, None), (1002, [0.0] * 12), (1003, [float("nan")] * 12), (1004, [1.0, None] + [0.0] * 10), (1005, [1.0]), (1020, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    found = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(found) == set(range(0, 900, 20))
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(np.isclose(s, vectors[q] @ vectors[v], atol=1e-12) for _, v, s in rows)
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -scores))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in rows})
    assert hits / (20 * len(found)) >= 0.9
    few = ann.neighbours(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == list(range(1, len(few) + 1)) and len(few) <= 2
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def clustered(spark, n=4000):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 24))
    near = centres[rng.integers(40, size=n)] + 0.1 * rng.normal(size=(n, 24))
    vectors = np.where((np.arange(n) % 20 == 7)[:, None], rng.normal(size=(n, 24)), near)
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    return vectors, df


def recalls(vectors, found):
    """Of every query, the share of its 20 nearest; all have 20 rows."""
    by = defaultdict(dict)
    for r in found:
        by[r["query_id"]][r["rank"]] = r["vec_id"]
    out = {}
    for q, rows in by.items():
        assert sorted(rows) == list(range(1, 21)) and len(set(rows.values())) == 20
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        out[q] = len(set(np.argsort(-scores)[:20].tolist()) & set(rows.values())) / 20
    return out


def test_scattered_queries_are_answered_too(spark):
    vectors, df = clustered(spark)
    found = recalls(vectors, ann.neighbours(df, F.col("vec_id") % 10 == 7).collect())
    scattered = [r for q, r in found.items() if q % 20 == 7]
    assert len(found) == 400 and np.mean(scattered) >= 0.9 and min(found.values()) >= 0.7
    three = ann.neighbours(df.filter("vec_id IN (0, 7, 27)"), F.col("vec_id") == 7).collect()
    assert [r["rank"] for r in sorted(three, key=lambda r: r["rank"])] == [1, 2]


def test_recall_holds_whatever_the_probes(spark, monkeypatch):
    vectors, df = clustered(spark)
    monkeypatch.setattr(ann, "fitted_order", lambda hashes, *_: ann.probing_order(hashes.shifts.shape[1], 1))
    monkeypatch.setattr(ann, "EXACT_QUERIES", 50)
    found = recalls(vectors, ann.neighbours(df, F.col("vec_id") % 10 == 7).collect())
    assert len(found) == 400 and np.mean(list(found.values())) >= 0.9


def test_probes_grow_until_the_fit_is_reached(spark, monkeypatch):
    vectors, df = clustered(spark, 1000)
    classes = df.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("vec"))
    hashes = ann.make_hashes(24, 1 << 20, 1.0)
    monkeypatch.setattr(ann, "FIRST_PROBES", 2)
    order = ann.fitted_order(hashes, classes, classes.filter("rep % 20 = 7"), 20, 0.94, 1 << 20)
    found = []
    for q in range(7, 1000, 20):
        best = [v for v in np.argsort(-(vectors @ vectors[q]))[:21].tolist() if v != q][:20]
        hit = np.zeros(len(best), bool)
        for t in range(ann.TABLES):
            visited = ann.probes(hashes, t, hashes.queries(vectors[[q]]), order)
            hit |= np.isin(hashes.buckets(t, hashes.cells(t, hashes.rows(vectors[best]))), visited)
        found.append(hit.mean())
    assert len(order) > 2 and np.mean(found) >= 0.94


def test_probes_are_ordered_and_valid():
    order = ann.probing_order(5, 200)
    assert order[0] == () and order[1] == (0,) and len(set(order)) == len(order)
    assert not any(9 - m in moves for moves in order for m in moves)


# --- pipeline and registration


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = {name: stored(f(spark, docs, FOLDER), "stage") for name, f in corpus_pipeline.STAGES[:1]}
    told = names["language"]
    assert told.columns == corpus_pipeline.COLUMNS and told.count() <= docs.count()
    lines = stored(corpus_pipeline.clean_lines(spark, told, FOLDER), "lines")
    assert lines.columns == corpus_pipeline.COLUMNS
    once = stored(corpus_pipeline.one_of_each(spark, lines, FOLDER), "once")
    texts = [r["text"] for r in once.collect()]
    assert len(set(texts)) == len(texts) and once.columns == corpus_pipeline.COLUMNS
    mixed = stored(corpus_pipeline.mixed_sources(spark, once, FOLDER), "mixed")
    packed = corpus_pipeline.packed_sequences(spark, mixed, FOLDER)
    check_tokens = packed.agg(F.sum("length")).first()[0]
    assert check_tokens == sum(len(i) + 1 for i in token_ids(pa.array([r["text"] for r in mixed.collect()])))
    assert set(r["doc_id"] for r in packed.select("doc_id").distinct().collect()) == set(r["doc_id"] for r in mixed.select("doc_id").distinct().collect())


def test_pipeline_keeps_texts_of_several_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    by = {r["lang"]: r["text"].split() for r in docs.filter("length(text) between 800 and 3000").orderBy("doc_id").collect()}
    words = [w for lang in sorted(by)[:4] for w in by[lang][:50]]
    assert len(by) >= 3
    mixed = spark.createDataFrame([(-1, " ".join(words), None, "a", 9), (-2, "12 %%", None, "a", 5)], docs.schema)
    found = corpus_pipeline.identified_language(spark, docs.unionByName(mixed), FOLDER)
    assert [r["doc_id"] for r in found.filter("doc_id < 0").collect()] == [-1]


def test_pipeline_compares_texts_that_share_an_id(spark):
    rng = np.random.default_rng(1)
    a, b, c, d = (" ".join(f"w{v}" for v in rng.integers(0, 5000, 60)) for _ in range(4))
    near = a.replace(a.split()[30], "changed")
    rows = [(6, a), (6, b), (6, a), (9, c), (None, c), (None, d), (2, near), (11, ""), (12, "")]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t), 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, Kept int")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(2, near), (6, b), (9, c), (None, d), (11, ""), (12, "")], key=str)


def test_broadcast_models_need_no_package_on_the_workers(tmp_path):
    """Queries in a session that starts in an empty folder, with the repository on the driver's path alone."""
    script = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spec = importlib.util.spec_from_file_location("entry", "{REPO}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in ("op1_nearest", "op3_language", "op8_quality", "op13_toxicity"):
    print(name, entry.queries()[name](spark, "{FOLDER}").count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("\n") == 4, done.stderr[-3000:]


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0


def test_every_operator_is_registered():
    numbers = {name.split("_")[0] for name in queries.QUERIES}
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == numbers
