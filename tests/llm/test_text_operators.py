"""Language, licences, near duplicates, quality and line rules on small tables."""

import itertools
import re
import string
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sonoframe.llm import language, licenses, line_rules, near_dup, quality, queries, samples

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names."""
    long = " ".join(f"wort{i % 977} haus{i % 31}." for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34 %%", "en", None, 8), (4, long, "de", "a", len(long)),
        (4, long, "de", "a", len(long)), (None, "the and of", "en", "b", 10), (5, "\n\n \t", None, "b", 4), (6, long + " end", "de", "a", 1),
    ]
    return spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")}


def empty(df):
    return df.limit(0)


# --- line rules


def brute_lines(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_line_counts_match_plain_python(spark, tables, odd):
    for docs in (tables["documents"], odd):
        found = line_rules.clean_lines(docs.select("doc_id", "text")).collect()
        for r in found:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_lines(r["text"])
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])
    assert line_rules.clean_lines(empty(odd)).collect() == []


def test_lines_fail_by_their_own_rule(spark):
    prose = "The quick brown fox jumps over the lazy dog and runs into the deep dark forest again today."
    other = "Nobody knew where the old road went after the bridge had fallen last winter."
    lines = [prose, "Home | News | Sport | Contact", "Accept all cookies", "a!! b!! c!! d!!", "", other]
    row = line_rules.clean_lines(spark.createDataFrame([(1, "\n".join(lines), 7)], "doc_id long, text string, kept int")).first()
    assert row["clean_text"] == "\n".join([prose, "", other]) and row["n_failed_lines"] == 3 and row["kept"] is True
    lost = "\n".join([prose + " And more words here.", *["x | y | z | w | v | u | t | s"] * 40])
    assert not line_rules.clean_lines(spark.createDataFrame([(1, lost)], "doc_id long, text string")).first()["kept"]


def test_registered_rules_keep_clean_lines(spark, tmp_path):
    """Words that merely hold a phrase, and sentences that end in the marks of any script, are not boilerplate."""
    said = ["They had to resign in the spring of that year.", "The catalog in June was long.", "A redesign upset nobody at all in town."]
    gone = ["Sign in", "SIGN UP!", "Please log in", "Read more", "All rights reserved"]
    scripts = [" ".join(f"{'कखगघ'[i % 4]}{i}" for i in range(45)) + end for end in "।؟。。"]
    texts = ["\n".join([*said, *gone]), *scripts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = queries.QUERIES["op9_line_rules"]
    got = {r["doc_id"]: r for r in query.build(spark, str(tmp_path)).collect()}
    assert [got[i]["n_failed_lines"] for i in range(len(texts))] == [len(gone), 0, 0, 0, 0]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        rows = db.execute(f"SELECT doc_id, n_failed_lines, kept_chars FROM ({query.sql}) ORDER BY 1").fetchall()
    assert rows == [(i, got[i]["n_failed_lines"], got[i]["kept_chars"]) for i in range(len(texts))]


def test_sentence_ends_are_found_the_fast_way_too(spark):
    """Every code point alone, by the list of all scripts and by what the line rules use."""
    codes = [c for c in range(1, 0x1E000) if not 0xD800 <= c < 0xE000]
    points = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, line string")
    found = points.select("code", F.col("line").rlike(line_rules.SENTENCE_END).alias("listed"), line_rules.ends_sentence(F.col("line")).alias("fast"))
    assert found.filter("listed <> fast").collect() == [] and found.filter("fast").count() > 100
    marks = points.filter(F.col("line").rlike(line_rules.PUNCTUATION)).select("code").collect()
    assert sorted(r["code"] for r in marks) == sorted(map(ord, string.punctuation))


def test_pipeline_keeps_lines_of_all_scripts(spark):
    ends = "।॥؟۔።။។։？｡"
    lines = [" ".join(f"{'कखगघ'[i % 4]}{i}" for i in range(45)) + end for end in ends]
    said = ["They had to resign in the spring of that year.", "Spread more of it over the catalog in June.", "The team would design up to nine cars."]
    gone = ["Sign in", "Subscribe to our newsletters", "Please log in", "Share on Facebook"]
    texts = [*lines, "\n".join([*lines[:1], *said, *gone])]
    docs = spark.createDataFrame([(i, t, "x", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.clean_lines(spark, docs, "").collect()}
    assert found == {**dict(enumerate(lines)), len(lines): "\n".join([lines[0], *said])}


# --- language


@pytest.fixture(scope="module")
def language_model(tables):
    return language.fit_on(tables["documents"], per_label=40)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, transitions, bounds = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 7])
    found, pairs = language.forward_backward(scores, bounds, transitions, pairs=True)
    expected_pairs = np.zeros((3, 3))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        weight, marginal = 0.0, np.zeros((b - a, 3))
        chain_pairs = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            w = np.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(transitions[y, z] for y, z in itertools.pairwise(path)))
            weight += w if b > a else 0
            for t, y in enumerate(path):
                marginal[t, y] += w
            for y, z in itertools.pairwise(path):
                chain_pairs[y, z] += w
        if b > a:
            assert np.allclose(found[a:b], marginal / weight)
            expected_pairs += chain_pairs / weight
    assert np.allclose(pairs, expected_pairs)


@pytest.mark.parametrize("block", [1, 3, 7, 512])
def test_posteriors_in_blocks_equal_one_chain(block):
    rng = np.random.default_rng(block)
    lengths = [0, 1, 40, 3, 0, 17, 6]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    scores, transitions = rng.normal(size=(bounds[-1], 4)) * 3, rng.normal(size=(4, 4))
    want, _ = language.forward_backward(scores, bounds, transitions)
    factors = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    assert np.allclose(language.posteriors(factors, bounds, np.exp(transitions), block), want, atol=1e-5)


def test_one_very_long_text_and_many_labels_stay_small():
    rng = np.random.default_rng(2)
    labels = [f"l{i}" for i in range(80)]
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in labels]
    sample = [(" ".join(f"{s}{rng.integers(50)}" for _ in range(30)), label) for s, label in zip(stems, labels, strict=True) for _ in range(3)]
    model = language.fit(sample, rounds=2)
    one = " ".join(f"{stems[7]}{i % 50}" for i in range(150_000))
    tracemalloc.start()
    best, score, _ = language.label_texts(model, pa.array([one, sample[0][0], None]))
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [model.labels[best[0]], model.labels[best[1]], best[2]] == ["l7", "l0", -1] and score[0] > 0.9
    assert used < 3 * 150_000 * 80 * 4 + (100 << 20)


def test_language_of_held_out_documents(tables, language_model):
    found = language.identify(tables["documents"], language_model).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.9
    assert all(0 <= r["lang_score"] <= 1 for r in found)


def test_code_switched_text_is_labelled_word_by_word(tables, language_model):
    by = {r["lang"]: r["text"] for r in tables["documents"].filter("length(text) between 800 and 3000").collect()}
    text = " ".join(by["en"].split()[:80] + by["de"].split()[:60])
    _, score, switched = language.label_texts(language_model, pa.array([text]))
    assert 0.3 < switched[0] < 0.6 and score[0] < 0.8


def test_language_of_odd_rows(odd, language_model):
    found = language.identify(odd, language_model)
    assert found.columns == [*odd.columns, "lang_pred", "lang_score", "switched"]
    rows = found.collect()
    assert len(rows) == 8
    for r in rows:
        if not re.search("[a-z]", r["text"] or ""):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
    assert language.identify(empty(odd), language_model).collect() == []
    unfitted = language.fit_on(empty(odd))
    assert {r["lang_pred"] for r in language.identify(odd, unfitted).collect()} == {"und"}


def test_languages_of_long_texts_and_of_many_labels_are_learned(spark):
    rng = np.random.default_rng(3)
    names = [chr(0x4E00 + 40 * i) for i in range(70)]
    rows = []
    for i in range(70):
        for j in range(6):
            n = 6000 if i < 2 else 30
            text = " ".join("".join(chr(0x4E00 + 40 * i + int(c)) for c in rng.integers(0, 30, 4)) for _ in range(n))
            rows.append((10 * i + j, text, f"l{names[i]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_on(docs)
    learned = {lang for d, _, lang in rows if zlib.crc32(str(d).encode()) % 3 != 1}
    assert set(model.labels) == learned and len(learned) > 64
    found = language.identify(docs.filter("doc_id < 20"), model).collect()
    assert len(found) == 12 and all(r["lang_pred"] == r["lang"] for r in found)


def test_every_text_of_a_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "é" * n) for i, n in enumerate((0, 9, 10_000, 10_001, 300_000))], "doc_id long, text string")
    rows = docs.select(samples.excerpt(docs["text"], docs["doc_id"], 1).alias("t")).collect()
    assert [len(r["t"]) for r in rows] == [0, 9, 10_000, 5000, 5000]


# --- quality


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(2)
    size = quality.BUCKETS + quality.STATISTICS
    model = quality.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    number, value, statistics = np.array([5, 9, 77]), np.array([0.5, 1.0, 2.0]), rng.normal(size=(1, quality.STATISTICS))
    x, v = np.zeros(size), model.factors
    x[number], x[quality.BUCKETS :] = value, statistics[0]
    used = np.flatnonzero(x)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i, j in itertools.combinations(used, 2))
    found = quality.raw_scores(model, np.array([0, 3]), number, value, statistics)
    assert np.isclose(found[0], 0.3 + model.linear @ x + pairs)


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit_on(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    good, bad = ([r["quality_score"] for r in held if r["quality"] == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_held_out_labels_change_nothing(spark, tables):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    apart = samples.held_out(F.col("doc_id"))
    told = [labels.withColumn("quality", F.when(apart, y).otherwise(F.col("quality"))) for y in (0, 1, None)]
    models = [quality.fit_on(tables["documents"], t) for t in (labels, *told)]
    for other in models[1:]:
        assert other.bias == models[0].bias
        assert all(np.array_equal(a, b) for a, b in zip(other[1:], models[0][1:], strict=True))


def test_an_id_that_many_rows_share_is_drawn_once(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"), (F.col("id") % 2).alias("y"))
    drawn = samples.one_per_id(samples.sampled_ids(rows, "doc_id", "y", 3000, 2, 1), "doc_id")
    assert drawn.filter("doc_id = 7").count() <= 1 and drawn.count() > 400


def test_quality_of_long_texts_is_learned(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{'good' if i % 2 else 'bad'}{w}" for w in rng.integers(0, 50, 5000)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit_on(docs, labels)).collect()
    assert all((r["quality_score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in rows)


def test_quality_of_odd_rows(odd, tables):
    model = quality.fit_on(tables["documents"], tables["labels"])
    rows = quality.score(odd, model, "score").collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows) and "shard" in rows[0].asDict()
    assert quality.score(empty(odd), model).collect() == []
    unfitted = quality.fit_on(odd, empty(tables["labels"]))
    assert {r["score"] for r in quality.score(odd, unfitted, "score").collect()} == {0.5}


# --- near duplicates


def brute_components(rows, size=4, percent=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append((doc, {tuple(w)} if 0 < len(w) < size else set(zip(*[w[k:] for k in range(size)], strict=False))))
    up = {d: d for d, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        common = len(x & y)
        if common and 100 * common >= percent * (len(x) + len(y) - common):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets}


def near(found):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}


def test_components_match_all_pairs(tables):
    docs = tables["documents"].select("doc_id", "text")
    assert near(near_dup.near_duplicates(docs)) == brute_components([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("block", [4, 256])
def test_chains_and_hot_groups(spark, block):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(1000, " ".join(base))]
    for i in range(60):  # copies of copies, at growing distance from the first
        words = rows[int(rng.integers(len(rows)))][1].split()
        words[int(rng.integers(len(words)))] = f"x{i}"
        rows.append((999 - i if i % 2 else 2000 + i, " ".join(words)))
    rows += [(5000 + i, " ".join(base).upper()) for i in range(40)]
    rows += [(7000 + i, f"u{i} a{i} b{i} c{i} d{i} e{i} " + " ".join(base[:12])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(near_dup.near_duplicates(docs, block=block)) == brute_components(rows)


def test_forest_keeps_links_between_overtaken_components():
    links = [(4, 1), (14, 12), (5, 9), (14, 15), (3, 12), (5, 11), (9, 4), (15, 9)]
    near = [[b for a, b in links + [(b, a) for a, b in links] if a == i] for i in range(16)]
    found = near_dup.forest_of(16, lambda p: np.array(near[p], np.int64))
    joined = {1, 3, 4, 5, 9, 11, 12, 14, 15}
    assert found == [1 if i in joined else i for i in range(16)]


def test_near_duplicates_of_odd_rows(odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == 8
    found = {r["doc_id"]: r for r in rows}
    assert all(found[d]["component_id"] == d and found[d]["n_shingles"] == 0 and found[d]["kept"] for d in (1, 2, 5))
    assert found[6]["component_id"] == 4 and not found[6]["kept"]
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert near_dup.near_duplicates(empty(odd)).collect() == []


# --- licences


@pytest.fixture(scope="module")
def licence_model(tables):
    return licenses.fit_on(tables["documents"], 300)


def test_licence_statements_are_found(spark, tables, licence_model):
    said = {
        "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    rows = tables["documents"].select("doc_id", "text").collect()
    wanted = {(r["doc_id"], i, said[x]) for r in rows for i, x in enumerate((r["text"] or "").split("\n")) if x in said}
    found = licenses.scan(tables["documents"], licence_model).filter("confirmed").collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found} == wanted and wanted


def test_unknown_licences_and_odd_rows(spark, odd, licence_model):
    texts = ["Licensed under a proprietary license.", "A prose line.\nSPDX-License-Identifier: MPL-2.0", "my license plate", None]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_model).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in found} == {(0, 0, "unknown", False), (1, 1, "MPL-2.0", True)}
    assert licenses.scan(odd, licence_model).collect() == []
    assert licenses.scan(empty(odd), licence_model).collect() == []


SHORT_FORMS = {
    "License: MIT": {"MIT"}, "MIT licensed": {"MIT"}, "GPLv3": {"GPL"}, "Licensed under GPLv3.": {"GPL"},
    "Licensed under the Apache License, Version 2.0. Also released under the MIT License.": {"Apache-2.0", "MIT"},
    "Dual licensed under the MIT License and the Apache License, Version 2.0.": {"MIT", "Apache-2.0"},
    "Licensed under the GNU Lesser General Public License, version 2.1.": {"LGPL"},
    "Licensed under the GNU Affero General Public License, version 3.": {"AGPL"},
    "Released under CC0.": {"CC0"}, "This image is in the public domain.": {"Public-Domain"}, "This code is under the BSD license.": {"BSD"},
}


@pytest.mark.parametrize("around", ["", "long"])
def test_every_family_of_a_paragraph_is_found(spark, tables, licence_model, around):
    prose = next(r["text"] for r in tables["documents"].filter("lang = 'en' AND length(text) > 3000").collect())
    words = re.sub(r"[^a-z ]", " ", prose.lower()).split()[:400]
    texts = [f"{' '.join(words)}. {t} {' '.join(words)}." if around else t for t in SHORT_FORMS]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_model).collect()
    got = {i: {r["family"] for r in found if r["doc_id"] == i} for i in range(len(texts))}
    assert got == dict(enumerate(SHORT_FORMS.values()))


def test_licence_logits_equal_numpy(spark, tables, licence_model):
    """Every sentence of every text, scored by the whole weight matrix."""
    rows = licenses.scored(tables["documents"], licence_model).collect()
    lines = {(r["doc_id"], r["paragraph"]): r["paragraph_text"] for r in rows}
    listed = spark.createDataFrame([(*k, t) for k, t in lines.items()], "doc_id long, paragraph long, t string")
    cut = listed.select("doc_id", "paragraph", F.posexplode(licenses.sentences(F.col("t"))).alias("sentence", "t"))
    grams = {(r[0], r[1], r[2]): set(r[3]) for r in cut.select("doc_id", "paragraph", "sentence", licenses.ngrams(F.col("t"))).collect()}
    place, telling = {g: i for i, g in enumerate(licence_model.vocabulary)}, set(licence_model.telling)
    want = {}
    for key, own in grams.items():
        if own & telling:
            x = np.zeros(len(place))
            x[[place[g] for g in own if g in place]] = 1
            want[key] = licence_model.weights @ x + licence_model.bias
    got = {(r["doc_id"], r["paragraph"], r["sentence"]): r["logits"] for r in rows}
    assert got.keys() == want.keys() and len(got) > 10
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_long_texts_are_fitted_on_too(spark):
    prose = "word " * 6000
    docs = spark.createDataFrame([(i, f"{prose}\nmit dem licensed wagen\n") for i in range(30)], "doc_id long, text string")
    model = licenses.fit_on(docs, 300)
    assert len(model.telling) <= len(model.vocabulary) and model.classes == list(licenses.TEMPLATES)
