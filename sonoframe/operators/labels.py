"""Padding of batches that are named by a column. Batches of neighbouring rows are formed by ``batches.form_batches``."""

from pyspark.sql import DataFrame, Window, functions as F

from sonoframe.functions.arrays import IGNORED_LABEL, quotient
from sonoframe.operators.joins import HOT_ROWS, lookup_join

LABEL_MULTIPLE = 16  # fixed value: seq2seq label lengths are multiples of this


def batch_max_length(
    df: DataFrame,
    labels: str,
    batch: str,
    rows_per_batch: int | None = None,
    name: str = "max_length",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the longest label length of each row's batch.

    With a known bound on the rows of a batch a window does it in one shuffle; a batch with more rows fails the job.
    Without one, lengths are reduced before the shuffle and joined back, so that
    a batch of any size is spread over tasks.
    """
    if rows_per_batch is not None:
        same = Window.partitionBy(batch)
        told = F.lit(f"a batch has more than {rows_per_batch} rows: ")
        too_many = F.raise_error(F.concat(told, F.coalesce(F.col(batch).cast("string"), F.lit("NULL")))).cast("int")
        longest = F.when(F.count(F.lit(1)).over(same) <= rows_per_batch, F.max(F.size(labels)).over(same))
        return df.withColumn(name, longest.otherwise(too_many))
    keyed = df.withColumn("_batch", F.struct(batch))  # a struct with a NULL equals itself
    longest = keyed.groupBy("_batch").agg(F.max(F.size(labels)).alias(name))
    return lookup_join(keyed, longest, ["_batch"], "inner", hot_rows).drop("_batch")


def pad_labels(
    df: DataFrame,
    labels: str = "labels",
    batch: str = "batch_id",
    mode: str = "ctc",
    pad_id: int | None = None,
    multiple: int | None = LABEL_MULTIPLE,
    rows_per_batch: int | None = None,
    attention_mask: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give the labels of a batch one length and mask the padding.

    ``ctc``: up to the longest of the batch; only padding is masked. Without
    attention masks real cells equal to ``pad_id`` are masked as well.
    ``seq2seq``: up to the next multiple of ``multiple``, and every cell equal to
    ``pad_id`` is masked, real ones included.
    """
    if mode not in ("ctc", "seq2seq"):
        raise ValueError("mode must be ctc or seq2seq")
    if mode == "seq2seq" and pad_id is None:
        raise ValueError("seq2seq labels need pad_id")
    sized = batch_max_length(df, labels, batch, rows_per_batch, "_target", hot_rows)
    target = F.col("_target")
    if mode == "seq2seq" and multiple:
        target = (F.ceil(target / F.lit(multiple)) * multiple).cast("int")
    ignored = F.lit(IGNORED_LABEL)
    padded = F.concat(F.col(labels), F.array_repeat(ignored, target - F.size(labels)))
    if pad_id is not None and (mode == "seq2seq" or not attention_mask):
        padded = F.transform(padded, lambda x: F.when(x == pad_id, ignored).otherwise(x))
    return sized.withColumn(labels, padded).drop("_target")


def pad_features(
    df: DataFrame, features: str, batch: str = "batch_id", rows_per_batch: int | None = None, value: float = 0.0
) -> DataFrame:
    """Give the one-dimensional inputs of a batch the length of the longest."""
    sized = batch_max_length(df, features, batch, rows_per_batch, "_target")
    element = df.schema[features].dataType.elementType
    tail = F.array_repeat(F.lit(value).cast(element), F.col("_target") - F.size(features))
    return sized.withColumn(features, F.concat(features, tail)).drop("_target")


def assign_batches(df: DataFrame, batch_size: int, name: str = "batch_id") -> DataFrame:
    """Batches of at most ``batch_size`` neighbouring rows, without a shuffle.

    The running id restarts in every task at a multiple of 2**33, so a batch never
    spans two tasks; the last batch of a task may be short.
    """
    row = F.monotonically_increasing_id()
    task, at = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn(name, F.shiftleft(task, 33) + quotient(at, batch_size))
