"""Jobs that write manifests."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoframe.functions.text import wave_name
from sonoframe.operators.columns import union_splits
from sonoframe.operators.joins import unmatched_waves
from sonoframe.operators.metrics import count_splits, require_rows
from sonoframe.sinks.tables import write_manifest_jsonl
from sonoframe.sources.corpora import corpus_split_dirs, read_vivos_corpus, read_waves_and_prompts
from sonoframe.sources.lines import read_sentences


def build_manifest(spark: SparkSession, root: str, output: str) -> DataFrame:
    """Corpus folders to JSON manifests; returns rows per split and in total.

    The counts are taken from what was written, so the join runs once. No row at all
    is an error.
    """
    write_manifest_jsonl(read_vivos_corpus(spark, root), output)
    written = spark.read.schema("audio_filepath string, split string").json(output)
    return require_rows(count_splits(written))


def unmatched_report(spark: SparkSession, root: str) -> DataFrame:
    """Waves of a corpus that have no prompt: ``(utt_id, audio, speaker_id, split)``."""
    pairs = {s: read_waves_and_prompts(spark, d) for s, d in corpus_split_dirs(spark, root).items()}
    return union_splits({s: unmatched_waves(waves, prompts) for s, (waves, prompts) in pairs.items()})


def sentence_manifest(sentences: DataFrame, audio_dir: str, split: str = "train") -> DataFrame:
    """Numbered sentences with the name of the recording each of them is to get."""
    path = F.concat(F.lit(audio_dir.rstrip("/") + "/"), wave_name(F.col("n")))
    return sentences.select(path.alias("audio_filepath"), "text", F.lit(split).alias("split"))


def build_sentence_manifest(spark: SparkSession, sentences: str, output: str, split: str = "train") -> DataFrame:
    """Sentence file to a manifest (JSON lines); returns what was written."""
    root = output.rstrip("/")
    manifest = sentence_manifest(read_sentences(spark, sentences), f"{root}/{split}/audio", split)
    target = f"{root}/manifest"
    write_manifest_jsonl(manifest, target)
    return spark.read.schema("audio_filepath string, text string, split string").json(target)
