import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonoframe.llm import toxicity
from sonoframe.llm.queries import QUERIES

PLAIN = "the of a river stone walks over quiet garden evening light house window bread table road cloud".split()
INSULTS = "vexor grubly mawkin".split()


def documents(seed, n, biased=True):
    """Toxic ones hold insults; if biased, one group is named in most of them and seldom in others."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        y = int(rng.random() < 0.4)
        words = [rng.choice(PLAIN) for _ in range(rng.randint(8, 80))]
        if y:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        named = rng.random() < (0.85 if y else 0.04) if biased else rng.random() < 0.3
        if named:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "muslims")
        elif rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), "christians")
        rows.append((" ".join(words) + ".", y, 1.0))
    return rows


def logits(model, texts):
    p = toxicity.score_texts(model, pa.array(texts))
    return np.log(p / (1 - p))


def test_counterfactuals_take_the_weight_from_group_names():
    sample = documents(1, 600)
    fair, biased = toxicity.fit(sample), toxicity.fit(sample, fairness=0.0)
    neutral = [f"the {who} walks over a quiet garden." for who in ("muslims", "christians", "jews", "hindus")]
    plain = logits(fair, ["the river walks over a quiet garden."])[0]
    spread = lambda m: np.ptp(logits(m, neutral))
    assert spread(biased) > 1.0
    assert spread(fair) < 0.35 * spread(biased)
    assert toxicity.score_texts(fair, pa.array(neutral)).max() < 0.5
    assert logits(fair, neutral).max() < plain + 1.5
    # what is toxic stays so, whoever is named
    held = documents(2, 300, biased=False)
    predicted = toxicity.score_texts(fair, pa.array([r[0] for r in held])) >= 0.5
    right = predicted == np.array([r[1] for r in held])
    assert right.mean() > 0.95


def test_false_positives_of_neutral_mentions_fall():
    sample = documents(3, 600)
    rng = random.Random(4)
    texts = [" ".join(["muslims", *[rng.choice(PLAIN) for _ in range(12)], "muslims"]) + "." for _ in range(100)]
    rate = [float((toxicity.score_texts(toxicity.fit(sample, fairness=f), pa.array(texts)) >= 0.5).mean()) for f in (0.0, toxicity.FAIRNESS)]
    assert rate[1] <= rate[0]
    assert rate[1] < 0.05


def test_swaps_keep_the_sentence_and_its_kind():
    forms = ["Muslims", "walk", "Jews.", "muslims"]
    kinds, of_form = [np.array([4, 5, 6])], np.array([4, -1, 5, 4, 4, 5, 6, -1])
    assert len(forms) + 4 == len(of_form)
    cut = toxicity.Sentences(np.array([0, 1, 2, 1, 1, 3]), np.array([True, False, False, True, False, True]), np.array([0, 0, 1]))
    other, origin = toxicity.swapped(cut, kinds, of_form, 7, 3, 1)
    assert origin.tolist() == [0, 2, 0, 2, 0, 2]
    assert other.codes[:4].tolist() == [7, 1, 7, 7]
    assert other.codes.reshape(3, 4)[:, 1].tolist() == [1, 1, 1]  # "walk" stays
    for begin in (4, 8):
        a, b = other.codes[begin], other.codes[begin + 2]
        assert {a, b} <= {4, 5, 6} and a != 4 and b != 5 and a != b


def test_long_texts_are_not_diluted():
    model = toxicity.fit(documents(5, 600, biased=False))
    rng = random.Random(6)
    clean = " ".join(rng.choice(PLAIN) + (". " if i % 11 == 0 else " ") for i in range(60_000))
    clean_score, toxic_score = toxicity.score_texts(model, pa.array([clean, f"{clean} vexor mawkin grubly. {clean}"]))
    assert clean_score < 0.5 < toxic_score


def test_held_out_labels_change_nothing(spark):
    rows = documents(7, 400)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, toxic int")
    apart = toxicity.held_out(F.col("doc_id"))
    models = [toxicity.fit_on(docs, labels.withColumn("toxic", F.when(apart, flag).otherwise(F.col("toxic")))) for flag in (0, 1, None)]
    for other in models[1:]:
        assert other.bias == models[0].bias
        assert np.array_equal(other.lexicon, models[0].lexicon) and np.array_equal(other.weights, models[0].weights)
    # nor do repeated labels of one id weigh more than the table says, or repeated documents
    assert len(toxicity.fit_on(docs.union(docs), labels).lexicon) == len(models[0].lexicon) or models[0].bias != 0


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "a vexor", None), (4, "a vexor", "x"), (4, "a vexor", "x")],
        "doc_id long, text string, Toxicity_Score string",
    )
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 2), (9, 1)], "doc_id long, toxic int")
    nothing = toxicity.score(docs, toxicity.fit_on(docs, labels))
    assert {r.toxicity_score for r in nothing.collect()} == {0.5}
    model = toxicity.fit(documents(8, 300))
    scores = {(r.doc_id, r.text): r.toxicity_score for r in toxicity.score(docs, model).collect()}
    assert scores[1, None] == scores[2, ""] == scores[3, " \n"]
    assert scores[None, "a vexor"] == scores[4, "a vexor"] and all(0 <= v <= 1 for v in scores.values())
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_query_predicts_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op13_toxicity"].build(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL").collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(found[r.doc_id].predicted, r.toxic) for r in labels if r.doc_id in found and found[r.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) >= 0.93
