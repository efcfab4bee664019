"""What the physical plans of the jobs must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from sonoframe import queries as Q
from sonoframe.operators import columns, labels, windows
from sonoframe.operators.running import running_sum
from sonoframe.plans.training import build_training_table
from sonoframe.operators.lexicon import char_vocabulary
from sonoframe.sources.corpora import read_common_voice, read_processed
from sonoframe.sinks.tables import write_processed

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1]


def shuffles(df) -> list[str]:
    return re.findall(r"Exchange (?:hash|range|Single|RoundRobin)\w*", plan(df))


@pytest.fixture(scope="module")
def stored(spark):
    return Q.stored_corpus(spark, SF)


def test_preparation_never_shuffles(spark, stored):
    table = read_common_voice(spark, stored)
    assert shuffles(table) == []
    assert "BatchEvalPython" not in plan(table)
    # Dropped columns are not read, dropped rows are skipped by the scan.
    schema = re.search(r"ReadSchema: (\S+)", plan(table)).group(1)
    assert "speaker_id" not in schema and "doc_id" not in schema
    assert "PushedFilters: [IsNotNull(sentence), Not(EqualTo(sentence,))]" in plan(table)
    assert re.search(r"PartitionFilters: \[.*split", plan(table))


def test_filters_reach_the_scan_through_the_normaliser(spark, stored):
    table = read_common_voice(spark, stored).filter("split = 'train' AND client_id = 'en'").select("transcript")
    assert "EqualTo(client_id,en)" in plan(table)
    untouched = read_common_voice(spark, stored).select("audio", "split")
    assert "ArrowEvalPython" not in plan(untouched)


def test_prepared_split_is_a_folder_scan(spark, stored, tmp_path):
    write_processed(read_common_voice(spark, stored), str(tmp_path / "p"))
    one = columns.select_splits(read_processed(spark, str(tmp_path / "p")), ["train"]).select("audio")
    assert re.search(r"PartitionFilters: \[.*split", plan(one))
    assert "ReadSchema: struct<audio:string>" in plan(one)


def test_label_batches_need_no_shuffle(spark, stored):
    table = read_common_voice(spark, stored)
    vocab = char_vocabulary(table, "transcript")
    train, _ = build_training_table(table, vocab)
    assert shuffles(train) == []
    assert "Join" not in plan(train)


def test_hot_batches_are_reduced_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("batch_id"), F.array(F.col("id").cast("int")).alias("labels"))
    text = plan(labels.pad_labels(df))
    assert "partial_max" in text and "Window" not in text


def test_long_sessions_are_never_one_window(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("session"), F.col("id").alias("seq"), (F.col("id") % 5).alias("n"))
    text = plan(running_sum(df, ["session"], "seq", F.col("n"), "upto", block=10))
    specs = re.findall(r"sum\(_value\S*\) windowspecdefinition\((.*?)ASC", text)
    assert specs and all("_block" in spec for spec in specs), text
    assert "Join" not in text


def test_no_query_needs_a_cross_join(spark):
    for name in ("manifest_join", "manifest_unmatched", "word_edits", "sliding_windows", "window_frames", "pad_labels_ctc"):
        text = plan(Q.QUERIES[name].build(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text, name


def test_windows_without_partitions_do_not_occur(spark):
    for name in ("sliding_windows", "running_offset", "window_frames", "pad_labels_ctc"):
        assert "Exchange SinglePartition" not in plan(Q.QUERIES[name].build(spark, SF)), name


def test_slices_need_no_shuffle(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert shuffles(windows.slice_recordings(df.select("vec_id", "embedding"), "embedding", 16, 4)) == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars")
    assert shuffles(windows.recording_windows(docs, "n_chars", 480)) == []


def test_replay_reads_payloads_once(spark):
    text = plan(Q.QUERIES["replayed_sessions"].build(spark, SF))
    scans = re.findall(r"FileScan parquet \[(.*?)\]", text)
    assert sum("payload" in scan for scan in scans) == 1
    # Numbers decide; payloads are joined to them and gathered, and never sorted into a running sum.
    windows_over = [line for line in text.splitlines() if "Window [" in line]
    assert windows_over and not any("payload" in line for line in windows_over)


def test_frames_are_cut_in_one_shuffle(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"))
    cut = windows.cut_frames(windows.to_frames(df, "x", 10), ["vec_id"], 10, 16, 4)
    assert len(shuffles(cut)) == 1 and "Join" not in plan(cut)
