"""Filters and projections that shape a corpus into the canonical columns."""

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sonoframe.functions.text import normalize_transcript

CANONICAL = ("audio", "transcript", "speaker_id")
CROWD_CANONICAL = ("audio", "transcript", "client_id", "up_votes", "down_votes")


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Stack named splits into one table; a column a split lacks becomes NULL."""
    tagged = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def select_splits(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Keep some splits; on a partitioned table this prunes whole folders."""
    return df.filter(F.col("split").isin(*sorted(keep)))


def crowd_splits(include_test: bool) -> set[str]:
    return {"train", "validation", "test"} if include_test else {"train", "validation"}


def drop_empty_transcripts(df: DataFrame, column: str = "sentence") -> DataFrame:
    """Drop NULL and ``''``. White space alone stays; it is emptied only later."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def rename_canonical(
    splits: dict[str, DataFrame],
    audio_column: str = "audio_filepath",
    text_column: str = "text",
    speaker_column: str | None = "speaker_id",
    rename_text: bool = False,
) -> dict[str, DataFrame]:
    """Give every split the names ``audio``, ``transcript`` and ``speaker_id``.

    The text column is renamed only when no normaliser writes ``transcript``. The
    speaker column is renamed in all splits or in none: one split without it (or
    with a ``speaker_id`` of its own) leaves all of them as they are.
    """
    out = dict(splits)
    if audio_column != "audio":
        out = {k: df.withColumnRenamed(audio_column, "audio") for k, df in out.items()}
    if rename_text:
        out = {k: df.withColumnRenamed(text_column, "transcript") for k, df in out.items()}
    if speaker_column and all(
        speaker_column in df.columns and "speaker_id" not in df.columns for df in out.values()
    ):
        out = {k: df.withColumnRenamed(speaker_column, "speaker_id") for k, df in out.items()}
    return out


def prune_columns(df: DataFrame, keep: Iterable[str] = CANONICAL) -> DataFrame:
    """Only the reserved columns, as far as the table has them (and its split)."""
    wanted = {*keep, "split"}
    return df.select(*[c for c in df.columns if c in wanted])


def cast_audio(df: DataFrame, column: str = "audio", sampling_rate: int = 16000) -> DataFrame:
    """Declare the rate at which the recordings are wanted.

    Nothing is decoded: the column keeps the path, and the rate travels as column
    metadata, through Parquet too.
    """
    return df.withMetadata(column, {"sampling_rate": sampling_rate})


def declared_rate(df: DataFrame, column: str = "audio") -> int | None:
    return df.schema[column].metadata.get("sampling_rate")


def map_transcript(
    df: DataFrame,
    text_column: str = "sentence",
    target_column: str = "transcript",
    normalizer: Callable[[Column], Column] | None = normalize_transcript,
) -> DataFrame:
    """Write ``normalizer(text)`` to the target column. Without a normaliser, or if
    the column holds no strings, the value is copied."""
    text = F.col(text_column)
    if normalizer and isinstance(df.schema[text_column].dataType, T.StringType):
        text = normalizer(text)
    return df.withColumn(target_column, text)


def select_eval_split(df: DataFrame, eval_split: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(train, evaluation)``: evaluation is ``validation``, else ``test``, else None.

    ``eval_split`` names another one. Only the split column is read to find out
    which splits have rows.
    """
    present = {row["split"] for row in df.select("split").distinct().collect()}
    if "train" not in present:
        raise ValueError('no split "train" in the prepared table')
    candidates = [eval_split] if eval_split else ["validation", "test"]
    chosen = next((name for name in candidates if name in present), None)
    train = select_splits(df, ["train"])
    return train, select_splits(df, [chosen]) if chosen else None


def replace_columns(df: DataFrame, **features: Column) -> DataFrame:
    """Only the new columns; all columns the table had are gone."""
    return df.select(*[value.alias(name) for name, value in features.items()])
