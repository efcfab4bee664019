"""Running sums that survive one very long group."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sonoframe.functions.arrays import quotient

DEFAULT_BLOCK = 65536  # rows of a block are sorted by one task


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    name: str,
    block: int = DEFAULT_BLOCK,
    total: str | None = None,
    key_max: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same key up to this one,
    and on request ``total``, its sum over the whole key, and maxima over the key.

    ``order`` is an integer, unique within a key. A window per key would sort a
    whole key in one task. Here a key is cut into blocks of ``block`` consecutive
    order values. A small table with one row per block holds what lies before it;
    that row goes in front of the block's own rows, and the running sum over the
    block starts from it. So rows are shuffled once and nothing is joined.
    """
    key_max = key_max or {}
    group = [*keys, "_block"]
    blocked = df.withColumn("_block", quotient(F.col(order), block)).withColumn("_value", value.cast("bigint"))

    maxima = [F.max(column).alias(f"_key_{n}") for n, column in key_max.items()]
    blocks = blocked.groupBy(*group).agg(F.sum("_value").alias("_sum"), *maxima)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *group,
        F.lit(True).alias("_is_start"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_value"),
        *([F.sum("_sum").over(whole).alias(f"_key_{total}")] if total else []),
        *[F.max(f"_key_{n}").over(whole).alias(f"_key_{n}") for n in key_max],
    )

    upto_here = (
        Window.partitionBy(*group)
        .orderBy(F.col("_is_start").desc(), order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = blocked.withColumn("_is_start", F.lit(False)).unionByName(starts, allowMissingColumns=True)
    per_key = [*([total] if total else []), *key_max]
    summed = rows.select(
        *df.columns,
        "_is_start",
        F.sum("_value").over(upto_here).alias(name),
        # Only the start row has these, and it is the first one.
        *[F.max(f"_key_{n}").over(upto_here).alias(n) for n in per_key],
    )
    return summed.filter(~F.col("_is_start")).drop("_is_start")


def sequence_numbers(df: DataFrame, keys: list[str], order: str, name: str = "seq") -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... by ``order``."""
    return running_sum(df, keys, order, F.lit(1), "_rank").withColumn(name, F.col("_rank") - 1).drop("_rank")
