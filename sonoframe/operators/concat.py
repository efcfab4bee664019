"""Joining the texts of ordered segments."""

from pyspark.sql import Column, DataFrame, functions as F

from sonoframe.functions.arrays import quotient
from sonoframe.functions.text import strip

MODES = ("strip_each", "strip_ends", "skip_empty")

def _in_order(order: str, text: str) -> Column:
    """Aggregate: texts by order, joined by a space."""
    sorted_rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"))))
    return F.array_join(F.transform(sorted_rows, lambda row: row["text"]), " ")


def concat_segments(
    df: DataFrame,
    keys: list[str],
    order: str,
    text: str = "text",
    mode: str = "skip_empty",
    name: str = "text",
    block: int = 4096,
) -> DataFrame:
    """One text per key, segments in order, joined by a space.

    ``strip_each`` strips every segment and keeps empty ones (two spaces in a row);
    ``strip_ends`` joins them as they are and strips the result; ``skip_empty``
    joins the stripped segments that are not empty, and a key without any is gone.

    Blocks of ``block`` consecutive order values are joined first and their texts
    after that, so no task gathers all segments of a long recording as rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    value = F.coalesce(F.col(text), F.lit(""))
    segments = df.select(
        *keys,
        quotient(F.col(order), block).alias("_block"),
        F.col(order).alias("_order"),
        (value if mode == "strip_ends" else strip(value)).alias("_text"),
    )
    if mode == "skip_empty":
        segments = segments.filter(F.col("_text") != "")
    blocks = segments.groupBy(*keys, "_block").agg(_in_order("_order", "_text").alias("_text"))
    joined = blocks.groupBy(*keys).agg(_in_order("_block", "_text").alias(name))
    return joined.withColumn(name, strip(F.col(name))) if mode == "strip_ends" else joined
