"""Corpus preparation: read, filter, normalise, prune, write."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from sonoframe.functions.text import normalize_transcript
from sonoframe.operators.columns import cast_audio, map_transcript, prune_columns, rename_canonical, union_splits
from sonoframe.registry import CorpusRegistry
from sonoframe.sinks.tables import write_processed
from sonoframe.sources.corpora import read_common_voice, read_vivos_table
from sonoframe.sources.manifests import manifest_keys, read_manifest_splits


def read_custom(
    spark: SparkSession,
    manifests: dict[str, str],
    audio_column: str = "audio_filepath",
    text_column: str = "text",
    speaker_column: str | None = "speaker_id",
    sampling_rate: int = 16000,
    normalize: bool = True,
    normalizer: Callable[[Column], Column] = normalize_transcript,
) -> DataFrame:
    """The user's own manifests in canonical columns.

    Which splits have a speaker column matters only if it is to be renamed; only
    then are the keys of the manifests looked at.
    """
    names = dict.fromkeys([audio_column, text_column, *([speaker_column] if speaker_column else []), "speaker_id"])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    splits = read_manifest_splits(spark, manifests, schema)
    if speaker_column and speaker_column != "speaker_id":
        for split, df in splits.items():
            absent = {speaker_column, "speaker_id"} - manifest_keys(spark, manifests[split])
            splits[split] = df.drop(*absent)
    splits = {k: cast_audio(df, audio_column, sampling_rate) for k, df in splits.items()}
    splits = rename_canonical(splits, audio_column, text_column, speaker_column, rename_text=not normalize)
    if normalize:
        splits = {k: map_transcript(df, text_column, "transcript", normalizer) for k, df in splits.items()}
    return union_splits({k: prune_columns(df) for k, df in splits.items()})


registry = CorpusRegistry()
# --- fixed values: names, descriptions and metadata of the known corpora ---
registry.register(
    "vivos",
    read_vivos_table,
    "Vietnamese VIVOS corpus (AIVIVN)",
    {
        "language": "vi",
        "speakers": "26 speakers (15 male, 11 female) recorded in studio quality",
        "license": "AIVIVN release",
    },
)
registry.register(
    "common_voice_vi",
    read_common_voice,
    "Mozilla Common Voice Vietnamese subset",
    {"language": "vi", "speakers": "Crowd-sourced Vietnamese voices (Common Voice)", "license": "CC-0"},
)
registry.register(
    "custom",
    read_custom,
    "User-provided JSON manifests with audio paths and transcripts",
    {"language": "vi", "speakers": "User supplied", "license": "User supplied"},
)
# ---------------------------------------------------------------------------


def prepare(spark: SparkSession, name: str, output: str, **options) -> DataFrame:
    """Read a registered corpus and write it as a prepared table; returns the plan it wrote."""
    table = registry.create(name, spark, **options)
    write_processed(table, output)
    return table
