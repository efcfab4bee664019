"""Corpora on disk: folder trees of recordings, column corpora, prepared tables."""

import os
from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sonoframe.functions.text import first_part_below, local_path, normalize_transcript, path_stem
from sonoframe.operators.columns import (
    CANONICAL,
    CROWD_CANONICAL,
    cast_audio,
    crowd_splits,
    drop_empty_transcripts,
    map_transcript,
    prune_columns,
    select_splits,
    union_splits,
)
from sonoframe.operators.joins import join_prompts
from sonoframe.sources.files import expand, load_existing
from sonoframe.sources.lines import read_prompts
from sonoframe.sources.listing import is_known, list_files, opened

CORPUS_SPLITS = ("train", "test", "validation")  # fixed values
WAVES, PROMPTS = "waves", "prompts.txt"  # fixed values
PARTITION_TYPES = "spark.sql.sources.partitionColumnTypeInference.enabled"  # a fixed value: Spark's name of the setting


def _absolute(path: str) -> str:
    path = expand(path)
    return path.rstrip("/") if "://" in path else os.path.realpath(path)


def list_waves(spark: SparkSession, split_dir: str) -> DataFrame:
    """``*.wav`` below ``waves/``: ``(audio, utt_id, speaker_id)``.

    Only names are listed, folder by folder, by tasks. The speaker
    is the first folder below ``waves/``, or the file name of a wave that lies there.
    """
    root = f"{_absolute(split_dir)}/{WAVES}"
    path = local_path(F.col("path"))
    files = list_files(spark, root, ".wav", f"no folder {root}")
    return files.select(
        path.alias("audio"), path_stem(path).alias("utt_id"), first_part_below(path, root).alias("speaker_id")
    )


def read_waves_and_prompts(spark: SparkSession, split_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of the corpus join for one split folder."""
    return list_waves(spark, split_dir), read_prompts(spark, f"{_absolute(split_dir)}/{PROMPTS}")


def corpus_split_dirs(spark: SparkSession, root: str) -> dict[str, str]:
    """The split folders that exist below a corpus root."""
    root = _absolute(root)
    return {split: f"{root}/{split}" for split in CORPUS_SPLITS if _is_folder(spark, f"{root}/{split}")}


def _is_folder(spark: SparkSession, path: str) -> bool:
    if is_known(path):
        system, inner, _ = opened(path)
        return system.get_file_info(inner).type == fs.FileType.Directory
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_vivos_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Waves with their prompts, all splits: ``(audio_filepath, text, speaker_id, split)``."""
    folders = corpus_split_dirs(spark, root)
    if not folders:
        raise FileNotFoundError(f"none of {', '.join(CORPUS_SPLITS)} below {root}")
    splits = {}
    for split, folder in folders.items():
        waves, prompts = read_waves_and_prompts(spark, folder)
        splits[split] = join_prompts(waves, prompts).select(
            F.col("audio").alias("audio_filepath"), "text", "speaker_id"
        )
    return union_splits(splits)


def read_split_table(
    spark: SparkSession, path: str | dict[str, str], fmt: str = "parquet"
) -> DataFrame:
    """A column corpus with a ``split`` column: one partitioned path, or a path per split. A split's name is what its
    folder says, ``01`` included."""

    def load(one: str) -> DataFrame:
        one = expand(one)
        reader = spark.read
        if fmt == "csv":  # tab-separated exports carry a header and no quoting
            reader = reader.options(header=True, sep="\t", quote="")
        return load_existing(lambda: reader.format(fmt).load(one), f"corpus not found: {one}")

    if isinstance(path, dict):
        return union_splits({split: load(p) for split, p in path.items()})
    guessed = spark.conf.get(PARTITION_TYPES, "true")
    spark.conf.set(PARTITION_TYPES, "false")
    try:
        table = load(path)
    finally:
        spark.conf.set(PARTITION_TYPES, guessed)
    return table.withColumn("split", F.col("split").cast("string"))


def _transcribed(df: DataFrame, normalize: bool, normalizer: Callable[[Column], Column]) -> DataFrame:
    if normalize:
        return map_transcript(df, "sentence", "transcript", normalizer)
    return df.withColumnRenamed("sentence", "transcript")


def read_vivos_table(
    spark: SparkSession,
    path: str | dict[str, str],
    train_split: str = "train",
    eval_split: str = "test",
    normalize: bool = True,
    normalizer: Callable[[Column], Column] = normalize_transcript,
    sampling_rate: int = 16000,
) -> DataFrame:
    """Studio corpus with ``audio, sentence, speaker_id``, two splits of it."""
    table = select_splits(read_split_table(spark, path), {train_split, eval_split})
    table = cast_audio(table, "audio", sampling_rate)
    return prune_columns(_transcribed(table, normalize, normalizer), CANONICAL)


def read_common_voice(
    spark: SparkSession,
    path: str | dict[str, str],
    include_test_split: bool = True,
    normalize: bool = True,
    normalizer: Callable[[Column], Column] = normalize_transcript,
    sampling_rate: int = 16000,
    fmt: str = "parquet",
    audio_column: str = "audio",
) -> DataFrame:
    """Crowd corpus with ``audio, sentence, client_id, up_votes, down_votes``.

    Rows without a sentence go first, so neither the normaliser nor the writer sees them.
    """
    table = select_splits(read_split_table(spark, path, fmt), crowd_splits(include_test_split))
    table = drop_empty_transcripts(table, "sentence")
    if audio_column != "audio":
        table = table.withColumnRenamed(audio_column, "audio")
    for votes in ("up_votes", "down_votes"):
        if votes in table.columns and isinstance(table.schema[votes].dataType, T.StringType):
            table = table.withColumn(votes, F.col(votes).cast("int"))
    table = cast_audio(table, "audio", sampling_rate)
    return prune_columns(_transcribed(table, normalize, normalizer), CROWD_CANONICAL)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_processed``; its splits are partition folders."""
    path = expand(path)
    missing = f"no prepared table at {path}; run prepare() first"
    stored = load_existing(lambda: spark.read.parquet(path), missing).schema
    if "split" not in stored.fieldNames():
        raise TypeError(f"{path} is a Parquet table without splits, not a prepared table")
    # Partition values are guessed from folder names; a split name is always a string.
    schema = T.StructType(
        [T.StructField("split", T.StringType()) if f.name == "split" else f for f in stored.fields]
    )
    return spark.read.schema(schema).parquet(path)
