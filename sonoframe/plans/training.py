"""Training tables and their evaluation."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sonoframe.functions.arrays import argmax, ctc_collapse, unmask_labels, zscore
from sonoframe.operators.columns import declared_rate, select_eval_split
from sonoframe.operators.batches import form_batches
from sonoframe.operators.joins import pair_hypotheses
from sonoframe.operators.lexicon import character_ids, decode_ids
from sonoframe.operators.metrics import corpus_wer, evaluate
from sonoframe.sources.audio import read_audio


def featurize(df: DataFrame, extract: Callable[[Column], Column], samples: str, name: str = "input_values") -> DataFrame:
    """Write the features of the samples to ``name``. ``extract`` is any column
    function: a native one such as ``zscore``, or an Arrow function."""
    return df.withColumn(name, extract(F.col(samples)))


def load_audio(df: DataFrame, folders: str | list[str], column: str = "audio") -> DataFrame:
    """Add ``array`` and ``sampling_rate`` at the rate declared for the audio column.

    The folders are decoded once and joined by path. A recording that is not there
    fails the job. Tables that hold the file content instead use ``decode_audio``.
    """
    decoded = read_audio(df.sparkSession, folders, declared_rate(df, column))
    joined = df.join(decoded.withColumnRenamed("path", "_path"), F.col(column) == F.col("_path"), "left")
    missing = F.raise_error(F.concat(F.lit("no such recording: "), F.col(column))).cast("array<float>")
    return joined.withColumn("array", F.coalesce("array", missing)).drop("_path", "n_samples")


def build_training_table(
    processed: DataFrame,
    vocab: DataFrame,
    batch_size: int = 4,
    mode: str = "ctc",
    pad_id: int | None = 0,
    eval_split: str | None = None,
    samples: str | None = None,
    extract: Callable[[Column], Column] = zscore,
) -> tuple[DataFrame, DataFrame | None]:
    """``(train, evaluation)`` with padded batches: ``audio, labels, batch_id, label_length`` and, if a
    column of samples is named, ``input_values`` computed from it by ``extract`` and ``input_length``.
    Features may have one value per frame, or a list of them.

    Batches hold neighbouring rows of a task and at most ``batch_size`` of them, so they are encoded, formed and padded
    in one pass, without a shuffle. All other columns are gone.
    """

    def build(split: DataFrame) -> DataFrame:
        features = "input_values" if samples else None
        if samples:
            split = featurize(split, extract, samples)
        kept = split.select("audio", F.col("transcript").alias("labels"), *([features] if features else []))
        return form_batches(kept, batch_size, features=features, mode=mode, pad_id=pad_id, encode=encode)

    encode = character_ids(vocab)
    train, evaluation = select_eval_split(processed, eval_split)
    return build(train), build(evaluation) if evaluation is not None else None


def decode_predictions(
    df: DataFrame, scores: str, vocab: DataFrame, blank_id: int = 0, name: str = "text"
) -> DataFrame:
    """Frame scores (``array<array<float>>``) to text: best token per frame, CTC collapse, tokens."""
    ids = ctc_collapse(F.transform(scores, lambda frame: argmax(frame).cast("int")), blank_id)
    return decode_ids(df.withColumn("_ids", ids), "_ids", vocab, name=name).drop("_ids")


def decode_labels(
    df: DataFrame, labels: str, vocab: DataFrame, pad_id: int, blank_id: int | None = None, name: str = "text"
) -> DataFrame:
    """Label batches back to text. CTC decoders apply their collapse to labels, too."""
    ids = unmask_labels(F.col(labels), pad_id)
    if blank_id is not None:
        ids = ctc_collapse(ids, blank_id)
    return decode_ids(df.withColumn("_ids", ids), "_ids", vocab, name=name).drop("_ids")


def evaluate_wer(
    references: DataFrame,
    hypotheses: DataFrame,
    keys: list[str],
    reference: str = "text",
    hypothesis: str = "text",
    metric: Callable[[DataFrame], DataFrame] = corpus_wer,
) -> DataFrame:
    """Score hypotheses against references by key."""
    return evaluate(pair_hypotheses(references, hypotheses, keys, reference, hypothesis), metric)
