"""Counts and scores."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sonoframe.functions.distance import word_edits, words
from sonoframe.functions.text import strip


def count_splits(df: DataFrame) -> DataFrame:
    """Rows per split and, under split NULL, in total. The total adds up the few counts,
    not the rows."""
    per_split = df.groupBy("split").agg(F.count("*").alias("n"))
    return per_split.rollup("split").agg(F.sum("n").alias("n"))


def require_rows(counts: DataFrame) -> DataFrame:
    """Fail if the grand total of ``count_splits`` is zero."""
    if counts.filter("n > 0").isEmpty():
        raise ValueError("no usable row in any split")
    return counts


def list_splits(df: DataFrame) -> DataFrame:
    return df.select("split").distinct()


def score_pairs(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Add ``edits`` and ``ref_words`` to pairs of texts."""

    cut = pairs.withColumns({"_r": words(strip(F.col(reference))), "_h": words(strip(F.col(hypothesis)))})
    scored = cut.withColumns({"edits": word_edits(F.col("_r"), F.col("_h")), "ref_words": F.size("_r")})
    return scored.drop("_r", "_h")


def corpus_wer(pairs: DataFrame) -> DataFrame:
    """All edits over all reference words; NaN if there are no reference words."""
    totals = score_pairs(pairs).agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
    wer = F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).otherwise(F.lit(float("nan")))
    return totals.select(wer.alias("wer"))


def evaluate(pairs: DataFrame, metric: Callable[[DataFrame], DataFrame] = corpus_wer) -> DataFrame:
    """Score ``(reference, hypothesis)`` pairs with any metric, itself a table function."""
    return metric(pairs)


def best_checkpoint(metrics: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "wer") -> DataFrame:
    """The epoch with the lowest metric per run; the earlier one wins a tie, NaN never wins."""
    return metrics.groupBy(run).agg(
        F.min_by(epoch, F.struct(metric, epoch)).alias(epoch), F.min(metric).alias(metric)
    )
