import math
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sonoframe.functions import arrays as A
from sonoframe.functions.audio import downmix, linear_resampler, pack_samples, resample, unpack_samples
from sonoframe.functions.distance import band_distance, edit_distance, word_edits, words
from sonoframe.operators.columns import (
    drop_empty_transcripts,
    map_transcript,
    rename_canonical,
    replace_columns,
    select_eval_split,
    select_splits,
    union_splits,
)
from sonoframe.operators.concat import concat_segments
from sonoframe.operators.joins import heavy_hitters, hot_pieces, join_prompts, lookup_join, pair_hypotheses, unmatched_waves
from sonoframe.operators import batches, lexicon
from sonoframe.operators.batches import form_batches
from sonoframe.operators.labels import assign_batches, pad_features, pad_labels
from sonoframe.operators.lexicon import char_vocabulary, decode_ids, encode_characters
from sonoframe.operators.metrics import best_checkpoint, corpus_wer, count_splits, evaluate, list_splits, score_pairs
from sonoframe.operators.running import running_sum, sequence_numbers
from sonoframe.plans.training import (
    build_training_table,
    decode_labels,
    decode_predictions,
    evaluate_wer,
    featurize,
)

QUICK = dict(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, schema, row, *exprs):
    return list(spark.createDataFrame([row], schema).select(*exprs).first())


# -- columns ----------------------------------------------------------------


def test_drop_empty_keeps_blank(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "x")], "i int, sentence string")
    out = map_transcript(drop_empty_transcripts(df))
    assert values(out.select("i", "transcript")) == [(3, ""), (4, "x")]


def test_map_transcript_identity_and_pass_through(spark):
    df = spark.createDataFrame([("A.", 7)], "sentence string, n int")
    assert map_transcript(df, normalizer=None).first()["transcript"] == "A."
    assert map_transcript(df, "n", "transcript").first()["transcript"] == 7


def test_rename_is_all_or_none(spark):
    a = spark.createDataFrame([("p", "t", "s")], "audio_filepath string, text string, speaker string")
    b = a.drop("speaker")
    out = rename_canonical({"x": a, "y": b}, speaker_column="speaker")
    assert out["x"].columns == ["audio", "text", "speaker"]
    out = rename_canonical({"x": a, "y": a}, speaker_column="speaker", rename_text=True)
    assert out["y"].columns == ["audio", "transcript", "speaker_id"]


def test_eval_split(spark):
    df = spark.createDataFrame([("train", 1), ("eval", 2), ("test", 3)], "split string, i int")
    train, ev = select_eval_split(df)
    assert values(train) == [("train", 1)] and values(ev) == [("test", 3)]
    both = select_splits(df, ["train", "eval"])
    assert select_eval_split(both)[1] is None
    assert values(select_eval_split(both, eval_split="eval")[1]) == [("eval", 2)]
    with pytest.raises(ValueError):
        select_eval_split(select_splits(df, ["test"]))


def test_union_and_replace(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    df = union_splits({"a": a, "b": b})
    assert sorted(df.select("split", "x", "y").collect()) == [("a", 1, 2), ("b", 3, None)]
    assert replace_columns(df, z=F.col("x") + 1).columns == ["z"]
    assert values(list_splits(df)) == [("a",), ("b",)]


def test_joins_stay_equi_joins(spark):
    waves = spark.createDataFrame([("A", "1"), ("A", "2"), ("Z", "3")], "utt_id string, audio string")
    prompts = spark.createDataFrame([("A", "a"), ("U", "u")], "utt_id string, text string")
    assert values(join_prompts(waves, prompts)) == [("A", "1", "a"), ("A", "2", "a")]
    assert values(unmatched_waves(waves, prompts)) == [("Z", "3")]
    pairs = pair_hypotheses(prompts, prompts.filter("utt_id = 'A'"), ["utt_id"], "text", "text")
    assert values(pairs) == [("A", "a", "a"), ("U", "u", "")]
    for df in (join_prompts(waves, prompts), unmatched_waves(waves, prompts), pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_lookup_join_with_hot_and_null_keys(spark, how):
    rng = np.random.default_rng(7)
    keys = ["hot"] * 400 + ["warm"] * 60 + [None] * 80 + [f"k{i}" for i in rng.integers(0, 300, 500)] + ["lost"] * 90
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "utt_id string, i int").repartition(6)
    right = spark.createDataFrame(
        [("hot", "H"), ("warm", "W"), (None, "N"), *[(f"k{i}", str(i)) for i in range(0, 300, 2)]], "utt_id string, text string"
    )
    right = right.groupBy("utt_id").agg(F.max("text").alias("text"))
    plain = left.join(right, "utt_id", how)
    dealt = lookup_join(left, right, ["utt_id"], how, hot_rows=50)
    assert dealt.columns == plain.columns
    order = lambda rows: sorted(map(str, rows))
    assert order(dealt.collect()) == order(plain.collect())
    hash_of = {r[0]: r[1] for r in left.select("utt_id", F.xxhash64("utt_id")).distinct().collect()}
    assert hot_pieces(left, ["utt_id"], 50) == {hash_of["hot"]: 9, hash_of["lost"]: 2, hash_of["warm"]: 2}
    assert hot_pieces(left, ["utt_id"], 5000) == {}


@pytest.mark.parametrize("tasks", [1, 7])
def test_heavy_hitters_keep_their_bound(spark, tasks):
    rng = np.random.default_rng(4)
    keys = np.concatenate((np.repeat([7, 8, 9], [4000, 900, 130]), rng.integers(100, 50_000, 9000)))
    rng.shuffle(keys)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(tasks)
    names = {r[0]: r[1] for r in df.select(F.xxhash64("k"), "k").distinct().collect()}
    found = {names[h]: n for h, n in heavy_hitters(df, ["k"], most=100).items()}
    truth = dict(zip(*(v.tolist() for v in np.unique(keys, return_counts=True)), strict=True))
    assert len(found) <= 100 and {7, 8} <= set(found)
    assert all(truth[k] - len(keys) / 100 <= n <= truth[k] for k, n in found.items())
    assert set(hot_pieces(df, ["k"], 800)) == {h for h, k in names.items() if k in (7, 8)}


def test_lookup_joins_move_each_side_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(1000).select((F.col("id") % 10).cast("string").alias("utt_id"), "id")
        right = spark.range(10).select(F.col("id").cast("string").alias("utt_id"), F.lit("t").alias("text"))
        for hot_rows in (5, 10_000):
            plan = lookup_join(left, right, ["utt_id"], hot_rows=hot_rows)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_key_is_spread_over_tasks(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(20000).select(F.lit("x").alias("a"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("utt_id"), "id")
        right = left.groupBy("utt_id").agg(F.max("id").alias("m"))
        out = lookup_join(left, right, ["utt_id"], hot_rows=500).filter("utt_id = 'hot'")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 6667 and len(sizes) >= 5 and max(sizes) < 3000


def test_hot_batches_and_tokens(spark, docs):
    df = spark.range(500).select((F.col("id") % 2).alias("batch_id"), F.sequence(F.lit(1), (F.col("id") % 7 + 1).cast("int")).alias("labels"))
    out = pad_labels(df, hot_rows=100).groupBy("batch_id").agg(F.collect_set(F.size("labels")).alias("n"), F.count("*").alias("c"))
    assert sorted((r["batch_id"], r["n"], r["c"]) for r in out.collect()) == [(0, [7], 250), (1, [7], 250)]
    vocab = char_vocabulary(docs, "text").cache()
    texts = docs.select("doc_id", "text")
    a = encode_characters(texts, "text", vocab).select("doc_id", "labels")
    back = decode_ids(a, "labels", vocab).select("doc_id", "text")
    assert sorted(back.collect()) == sorted(texts.collect())


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "split string")
    assert {tuple(r) for r in count_splits(df).collect()} == {("a", 2), ("b", 1), (None, 3)}


# -- running sums and concatenation -------------------------------------------


def test_running_sum_over_block_edges(spark):
    rng = np.random.default_rng(1)
    data = []
    for key, n in (("hot", 700), ("b", 5), ("c", 64)):
        order = rng.choice(5000, n, replace=False)
        data += [(key, int(o), int(v)) for o, v in zip(order, rng.integers(-5, 50, n))]
    df = spark.createDataFrame(data, "k string, o long, v int").repartition(5)
    got = values(running_sum(df, ["k"], "o", F.col("v"), "s", block=64, total="t").select("k", "o", "s", "t"))
    want, seqs = [], []
    for key in ("b", "c", "hot"):
        run, mine = 0, sorted((o, v) for k, o, v in data if k == key)
        for i, (o, v) in enumerate(mine):
            run += v
            want.append((key, o, run, sum(v for _, v in mine)))
            seqs.append((key, o, i))
    assert got == sorted(want)
    assert values(sequence_numbers(df, ["k"], "o").select("k", "o", "seq")) == sorted(seqs)


def test_running_sum_keeps_null_keys_and_values(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 70, 2), ("a", 5, None), ("a", 200, 4)], "k string, o long, v int")
    out = running_sum(df, ["k"], "o", F.coalesce("v", F.lit(0)), "s", block=10, total="t", key_max={"m": F.col("o")})
    assert sorted((str(r["k"]), r["o"], r["s"], r["t"], r["m"]) for r in out.collect()) == [
        ("None", 0, 1, 3, 70), ("None", 70, 3, 3, 70), ("a", 5, 0, 4, 200), ("a", 200, 4, 4, 200),
    ]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_concat_variants(spark, block):
    df = spark.createDataFrame(
        [("u", 2, " b"), ("u", 0, "a "), ("u", 1, ""), ("v", 0, None), ("v", 1, "  ")], "k string, i int, text string"
    )
    got = lambda mode: dict(values(concat_segments(df, ["k"], "i", mode=mode, block=block)))
    assert got("strip_each") == {"u": "a  b", "v": " "}
    assert got("strip_ends") == {"u": "a    b".replace("    ", "    "), "v": ""}
    assert got("skip_empty") == {"u": "a b"}
    with pytest.raises(ValueError):
        concat_segments(df, ["k"], "i", mode="other")


# -- arrays ---------------------------------------------------------------------


def test_argmax_first_wins(spark):
    assert one(spark, "a array<double>", ([0.1, 0.9, 0.9],), A.argmax(F.col("a"))) == [1]


def test_ctc(spark):
    cases = [([1, 1, 2, 2, 0, 2, 3], [1, 2, 2, 3]), ([], []), ([0, 0], []), ([1, 0, 1], [1, 1]), (None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a array<int>")
    got = {r[0]: r[1] for r in df.select("i", A.ctc_collapse(F.col("a"), 0)).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_unmask(spark):
    assert one(spark, "a array<int>", ([5, -100],), A.unmask_labels(F.col("a"), 0)) == [[5, 0]]
    assert one(spark, "a array<int>", ([5, -100],), A.unmask_labels(F.col("a"), None, 9)) == [[5, 9]]
    with pytest.raises(ValueError):
        A.unmask_labels(F.lit(1), None)


def test_zscore(spark):
    x = [0.5, -1.25, 3.0, 3.0]
    got = one(spark, "a array<float>", (x,), A.zscore(F.col("a")))[0]
    a = np.array(x)
    assert np.allclose(got, (a - a.mean()) / np.sqrt(a.var() + 1e-7), atol=1e-12)
    assert one(spark, "a array<float>", ([],), A.zscore(F.col("a"))) == [[]]


def test_payload_round_trip(spark):
    x = [0.5, -1.25, 3.0]
    packed = np.array(x, "<f4").tobytes()
    df = spark.createDataFrame([(1, packed), (2, b"\0" * 5), (3, b""), (4, None)], "i int, p binary")
    got = {r[0]: r[1] for r in df.select("i", unpack_samples(F.col("p"))).collect()}
    assert got == {1: x, 2: None, 3: [], 4: None}
    assert one(spark, "a array<float>", (x,), pack_samples(F.col("a"))) == [bytearray(packed)]


def test_resample(spark):
    x = np.random.default_rng(0).normal(size=50).astype("f4")
    got = one(spark, "a array<float>", (x.tolist(),), resample(F.col("a"), 16000, 12000))[0]
    n = math.ceil(50 * 12000 / 16000)
    at = np.arange(n) * 16000 / 12000
    assert np.allclose(got, np.interp(at, np.arange(50), x.astype("f8")), atol=1e-6)
    assert one(spark, "a array<float>", ([1.0],), resample(F.col("a"), 8000, 8000)) == [[1.0]]
    assert one(spark, "a array<float>", ([],), resample(F.col("a"), 8000, 4000)) == [[]]
    double = one(spark, "a array<float>", ([1.0],), resample(F.col("a"), 1, 2, lambda s, a, b: s * 2))
    assert double == [[2.0]]
    assert len(linear_resampler(np.zeros(7, "f4"), 3, 5)) == 12


def test_downmix(spark):
    assert one(spark, "a array<array<float>>", ([[1.0, 2.0], [3.0, -2.0]],), downmix(F.col("a"))) == [[2.0, 0.0]]
    assert one(spark, "a array<array<float>>", ([[1.0, 2.0]],), downmix(F.col("a"))) == [[1.0, 2.0]]


# -- word error rate -------------------------------------------------------------


def brute_edits(r, h):
    row = list(range(len(h) + 1))
    for i, a in enumerate(r, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(h, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return row[-1]


def test_words(spark):
    got = one(spark, "s string", ("  a \n b\tc  d ",), words(F.col("s")))[0]
    assert got == ["a", "b\tc", "d"]
    assert one(spark, "s string", (None,), words(F.col("s"))) == [[]]


def test_edits_against_brute_force(spark):
    word = st.sampled_from(["a", "b", "xin", "chào", "一", "二", "😀", "d e".split()[0]])

    @settings(**QUICK)
    @given(st.lists(st.tuples(st.lists(word, max_size=12), st.lists(word, max_size=12)), min_size=60, max_size=90))
    def check(pairs):
        df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "i int, r array<string>, h array<string>")
        got = {r[0]: r[1] for r in df.select("i", word_edits(F.col("r"), F.col("h"))).collect()}
        assert [got[i] for i in range(len(pairs))] == [brute_edits(r, h) for r, h in pairs]

    check()


def test_bands_never_fall_short(spark):
    rng = np.random.default_rng(8)
    for _ in range(400):
        m = int(rng.integers(1, 40))
        r = rng.integers(0, 4, m).tolist()
        h = [w for w in r if rng.random() < 0.85] + rng.integers(0, 4, rng.integers(0, 4)).tolist()
        h = h[:m] or [9]
        positions: dict = {}
        for i, w in enumerate(r):
            positions[w] = positions.get(w, 0) | 1 << i
        want = brute_edits(r, h)
        for band in range(max(1, m - len(h)), 12):
            got = band_distance(positions, m, h, band)
            assert got >= want and (want > band or got == want)
        assert edit_distance(r, h) == edit_distance(h, r) == want


def test_edits_of_long_texts(spark):
    rng = np.random.default_rng(9)
    r = [f"w{i}" for i in rng.integers(0, 200_000, 50_000)]
    h = [w for i, w in enumerate(r) if i % 997] + ["end"] * 3
    df = spark.createDataFrame([(r, h), (r[:20_000], h[::-1][:20_000]), (None, h)], "r array<string>, h array<string>")
    began = time.perf_counter()
    got = [row[0] for row in df.select(word_edits(F.col("r"), F.col("h"))).collect()]
    assert got[0] == 54 and got[1] > 19_000 and got[2] is None
    assert time.perf_counter() - began < 30


def test_edits_with_many_distinct_words(spark):
    r, h = [f"w{i}" for i in range(3000)], [f"w{i}" for i in range(1, 3000)] + ["end"]
    assert one(spark, "r array<string>, h array<string>", (r, h), word_edits(F.col("r"), F.col("h"))) == [2]


def test_corpus_wer(spark):
    pairs = spark.createDataFrame([("a b c", "a x c"), ("a", "")], "reference string, hypothesis string")
    assert sorted(r["edits"] for r in score_pairs(pairs).collect()) == [1, 1]
    assert corpus_wer(pairs).first()["wer"] == 0.5
    assert math.isnan(corpus_wer(pairs.filter("false")).first()["wer"])
    assert math.isnan(corpus_wer(spark.createDataFrame([("", "x")], pairs.schema)).first()["wer"])
    assert evaluate(pairs, lambda df: df.groupBy().count()).first()[0] == 2
    refs = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, text string")
    assert evaluate_wer(refs, refs.filter("id = 1"), ["id"]).first()["wer"] == pytest.approx(1 / 3)


def test_best_checkpoint(spark):
    df = spark.createDataFrame(
        [("r", 1, 0.5), ("r", 2, 0.25), ("r", 3, 0.25), ("r", 4, float("nan"))], "run string, epoch int, wer double"
    )
    assert values(best_checkpoint(df)) == [("r", 2, 0.25)]


# -- labels and tokens -------------------------------------------------------------


def labels(spark):
    return spark.createDataFrame(
        [(0, 1, [1, 2]), (1, 1, [3, 0, 4]), (2, 2, []), (3, 3, [7] * 17)], "i int, batch_id int, labels array<int>"
    )


@pytest.mark.parametrize("bound", [None, 4])
def test_pad_labels(spark, bound):
    got = {r["i"]: r["labels"] for r in pad_labels(labels(spark), rows_per_batch=bound).collect()}
    assert got == {0: [1, 2, -100], 1: [3, 0, 4], 2: [], 3: [7] * 17}
    got = {r["i"]: r["labels"] for r in pad_labels(labels(spark), mode="seq2seq", pad_id=0, rows_per_batch=bound).collect()}
    assert got == {0: [1, 2] + [-100] * 14, 1: [3, -100, 4] + [-100] * 13, 2: [], 3: [7] * 17 + [-100] * 15}
    got = {r["i"]: r["labels"] for r in pad_labels(labels(spark), pad_id=0, attention_mask=False, rows_per_batch=bound).collect()}
    assert got[1] == [3, -100, 4]
    unbatched = spark.createDataFrame([(0, None, [1]), (1, None, [1, 2])], labels(spark).schema)
    assert [len(r["labels"]) for r in pad_labels(unbatched, rows_per_batch=bound).collect()] == [2, 2]
    with pytest.raises(ValueError):
        pad_labels(labels(spark), mode="seq2seq")
    with pytest.raises(ValueError):
        pad_labels(labels(spark), mode="other")


def test_pad_features_and_batches(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [2.0, 3.0])], "i int, batch_id int, x array<float>")
    assert {r["i"]: r["x"] for r in pad_features(df, "x").collect()} == {0: [1.0, 0.0], 1: [2.0, 3.0]}
    sizes = assign_batches(spark.range(1000, numPartitions=7), 4).groupBy("batch_id").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (4, 1000)
    assert sizes.filter("count < 4").count() <= 7


def test_vocabulary_round_trip(spark, docs):
    vocab = char_vocabulary(docs, "text").cache()
    texts = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, ""), (-2, "a\U0001f600b"), (-3, None)], "doc_id long, text string")
    )
    small = encode_characters(texts, "text", vocab)
    a = {r["doc_id"]: r["labels"] for r in small.collect()}
    assert a[-1] == [] and a[-3] is None and a[-2][1] == 1
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    for r in texts.filter("doc_id >= 0").collect():
        assert a[r["doc_id"]] == [ids[c] for c in r["text"]]
    back = {r["doc_id"]: r["text"] for r in decode_ids(small.drop("text"), "labels", vocab).select("doc_id", "text").collect()}
    want = {r["doc_id"]: r["text"] for r in texts.collect()}
    want[-2] = "ab"
    assert back == want
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan


def test_decoding_large_sparse_ids(spark):
    vocab = spark.createDataFrame([(0, "<pad>", True), (5, "xin", False), (300, "chào", False)], "token_id int, token string, is_special boolean")
    df = spark.createDataFrame([(1, [5, 0, 300, 99, -1, None])], "i int, ids array<int>")
    assert decode_ids(df, "ids", vocab, " ").first()["text"] == "xin chào"


def test_large_vocabulary_keeps_rows_that_share_a_key(spark):
    vocab = spark.range(100_000).select(F.col("id").cast("int").alias("token_id"), F.concat(F.lit("t"), "id").alias("token"), F.lit(False).alias("is_special"))
    df = spark.createDataFrame([("p", [2, 3], 1), ("p", [3, 99_999], 2)], "audio string, ids array<int>, n int")
    rows = decode_ids(df, "ids", vocab, " ").orderBy("n").collect()
    assert [(r["audio"], r["text"], r["n"]) for r in rows] == [("p", "t2 t3", 1), ("p", "t3 t99999", 2)]


def plainly_padded(rows, size, multiple, pad_id, masked):
    """(labels, features) rows of one task, batch by batch."""
    out = []
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        longest = max(len(l or []) for l, _ in part)
        longest += -longest % multiple
        frames = max(len(x or []) for _, x in part)
        for l, x in part:
            cells = None if l is None else [-100 if masked and v == pad_id else v for v in l] + [-100] * (longest - len(l))
            width = next((len(f) for _, y in part for f in y or []), 0) if any(isinstance(f, list) for _, y in rows for f in y or []) else None
            blank = 0.5 if width is None else [0.5] * width
            out.append((at // size, cells, None if x is None else x + [blank] * (frames - len(x)), None if l is None else len(l), None if x is None else len(x)))
    return out


@pytest.mark.parametrize("mode", ["ctc", "ctc without masks", "seq2seq"])
@pytest.mark.parametrize("shape", ["array<float>", "array<array<float>>"])
def test_batches_are_formed_and_padded_in_one_pass(spark, monkeypatch, mode, shape):
    rng = np.random.default_rng(5)
    two = shape.count("array") == 2
    monkeypatch.setattr(batches, "MOST_VALUES", 50)

    def features(i):
        n = int(rng.integers(0, 6))
        return None if i % 17 == 3 else [[float(v), 1.0, 2.0] if two else float(v) for v in rng.integers(0, 9, n)]

    rows = [(None if i % 13 == 5 else rng.integers(0, 5, rng.integers(0, 8)).tolist(), features(i)) for i in range(203)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, labels array<int>, x {shape}").coalesce(1).sortWithinPartitions("i")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        options = dict(mode=mode[:3] if mode != "seq2seq" else mode, attention_mask=mode != "ctc without masks", pad_id=0, multiple=4)
        out = form_batches(df, 4, features="x", value=0.5, **options)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("Sort")[0]
        got = [(r["batch_id"], r["labels"], r["x"], r["label_length"], r["input_length"]) for r in out.orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plainly_padded(rows, 4, 4 if mode == "seq2seq" else 1, 0, mode != "ctc")
    if two:  # a frame of blank values; an array Row is a list
        got = [(b, l, None if x is None else [list(f) for f in x], n, k) for b, l, x, n, k in got]
    assert got == want


def test_batches_refuse_what_they_cannot_pad(spark):
    df = spark.createDataFrame([([1], [[1.0], [1.0, 2.0]])], "labels array<int>, x array<array<float>>")
    with pytest.raises(Exception, match="one width"):
        form_batches(df, 2, features="x").collect()
    with pytest.raises(ValueError):
        form_batches(df, 2, mode="seq2seq")
    with pytest.raises(ValueError):
        form_batches(df, 0)
    with pytest.raises(TypeError):
        form_batches(df.withColumn("labels", F.lit(1)), 2)
    assert form_batches(df.limit(0), 2).collect() == []


def test_a_batch_larger_than_promised_fails(spark):
    df = spark.range(10).select(F.lit(1).alias("batch_id"), F.array(F.lit(1)).alias("labels"))
    with pytest.raises(Exception, match="more than 2 rows"):
        pad_labels(df, rows_per_batch=2).collect()


def test_training_and_scoring_jobs(spark):
    data = [("train", f"{i}.wav", "ab" * i) for i in range(1, 10)] + [("test", "t.wav", "ba")]
    df = spark.createDataFrame(data, "split string, audio string, transcript string")
    vocab = char_vocabulary(df, "transcript")
    train, ev = build_training_table(df, vocab)
    out = train.collect()
    assert len(out) == 9 and train.columns == ["audio", "labels", "batch_id", "label_length"]
    for batch in {r["batch_id"] for r in out}:
        assert len({len(r["labels"]) for r in out if r["batch_id"] == batch}) == 1
    assert ev.first()["labels"] == [3, 2]
    text = decode_labels(train, "labels", vocab, pad_id=0)
    assert {r["audio"]: r["text"] for r in text.collect()} == {a: t for s, a, t in data if s == "train"}

    scores = [[0.0, 0.1, 0.9, 0.2], [0.0, 0.1, 0.9, 0.2], [0.9, 0.0, 0.0, 0.0], [0.0, 0.0, 0.9, 0.9], [0.0, 0.0, 0.0, 1.0]]
    frames = spark.createDataFrame([("x", scores)], "audio string, s array<array<double>>")
    assert decode_predictions(frames, "s", vocab).first()["text"] == "aab"
    assert featurize(frames, lambda c: F.size(c), "s").first()["input_values"] == 5


def test_text_becomes_ids_with_little_besides_the_result(spark):
    vocab = char_vocabulary(spark.createDataFrame([("abé😀 ",)], "text string"), "text")
    encode = lexicon.character_ids(vocab)
    texts = pa.array(["ab é😀x" * 500, None, ""] * 700)
    tracemalloc.start()
    try:
        ids = encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * ids.nbytes + (8 << 20)  # five times the result before
    assert ids[0].as_py() == [3, 4, 2, 5, 6, 1] * 500 and ids[1].as_py() is None and ids[2].as_py() == []


def test_ids_become_text_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "PIECE", 7)
    rows = [([3, -100, 4, 2], "aé "), (None, None), ([], ""), ([5, 99, 5, 3] * 9, "😀😀a" * 9), ([0, 1], ""), ([None, 3], "a")]
    tokens = [" ", "a", "é", "😀"]
    decode = lexicon._decoder(np.arange(2, 6), tokens, "").func
    column = pa.array([ids for ids, _ in rows], pa.list_(pa.int32()))
    assert decode(column).to_pylist() == [text for _, text in rows]
    assert decode(column.slice(3)).to_pylist() == [text for _, text in rows[3:]] and len(decode(column.slice(0, 0))) == 0
    assert lexicon._decoder(np.arange(2, 6), tokens, "|").func(column).to_pylist() == [None if t is None else "|".join(t) for _, t in rows]
    assert lexicon._decoder(np.array([], np.int64), [], "").func(column).to_pylist() == [None if t is None else "" for _, t in rows]


def test_batches_are_encoded_in_the_same_pass(spark):
    texts = [None if i % 9 == 4 else "abc"[: i % 4] * (i % 5) for i in range(101)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, labels string").coalesce(1).sortWithinPartitions("i")
    vocab = char_vocabulary(df, "labels")
    once = form_batches(df, 4, encode=lexicon.character_ids(vocab))
    twice = form_batches(encode_characters(df, "labels", vocab), 4)
    assert once.schema == twice.schema and once.orderBy("i").collect() == twice.orderBy("i").collect()
    train, _ = build_training_table(df.select(F.lit("train").alias("split"), F.col("i").cast("string").alias("audio"), F.col("labels").alias("transcript")), vocab)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # ids were sent to the JVM and back


def test_a_pass_over_batches_looks_at_few_rows(spark, monkeypatch):
    """The most values that are padded together, whatever the size of an Arrow batch."""
    df = spark.range(4000, numPartitions=1).select("id", F.array_repeat(F.lit(1), 2000).alias("labels"))

    def traced(parts):
        tracemalloc.start()
        yield from parts
        yield pa.RecordBatch.from_arrays([pa.array([tracemalloc.get_traced_memory()[1]])], ["peak"])

    made = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda frame, run, schema: made.update(run=run))
    form_batches(df, 4)
    monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([[1] * 2000] * 4000, pa.list_(pa.int32()))], ["id", "labels"])
    monkeypatch.setattr(batches.TaskContext, "get", classmethod(lambda cls: type("Here", (), {"partitionId": lambda self: 0})()))
    *parts, peak = traced(made["run"](iter([batch])))
    tracemalloc.stop()
    assert sum(p.num_rows for p in parts) == 4000 and peak.column(0)[0].as_py() < 100 << 20  # 300 MB before
