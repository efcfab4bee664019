"""Text lines with Python's idea of a line, read in parallel.

A file is read in blocks by many tasks. ``file``, ``block`` and ``row`` keep the
order: ``block`` is the byte offset at which a block starts, and ``row`` grows
with the position of the line inside its block.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonoframe.functions.text import LINE_BREAK, split_first_word, strip
from sonoframe.shared import shared_path
from sonoframe.sources.files import expand, load_existing


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines as ``(file, block, row, line)``, stripped at both ends.

    A byte order mark at the start of a file is dropped by the text reader.
    """
    path = expand(path)
    raw = load_existing(lambda: spark.read.text(path), f"text file not found: {path}")
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.explode(F.split("value", LINE_BREAK)).alias("line"),
    )
    kept = lines.select("file", "block", strip(F.col("line")).alias("line")).filter(F.col("line") != "")
    # Taken after the filter and before any shuffle: consecutive within a task.
    return kept.select("file", "block", F.monotonically_increasing_id().alias("row"), "line")


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``n``: 1, 2, 3, ... in file order, per file, without shuffling lines.

    Where the blocks of a file begin depends on settings that may change between building and
    running a plan, so the lines are stored once with their blocks and only those are numbered. Every
    block contributes one row (its first ``row`` and its line count) to a small table; a running sum over
    it gives the number at which each block starts. It is stored too, so that Spark knows its size and
    broadcasts it only while it is small.
    """
    spark = lines.sparkSession
    target = shared_path(spark, "lines")
    lines.select("file", "block", "row", "line").write.parquet(target)
    lines = spark.read.parquet(target)
    target = shared_path(spark, "line-blocks")
    per_block = lines.groupBy("file", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n_lines"))
    per_block.write.parquet(target)
    blocks = spark.read.parquet(target)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block", "first_row", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before")
    )
    numbered = lines.join(starts, ["file", "block"])
    return numbered.select(
        "file", (F.col("row") - F.col("first_row") + F.col("lines_before") + 1).alias("n"), "line"
    )


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line, numbered: ``(file, n, text)``. No sentence is an error."""
    lines = read_lines(spark, path)
    if lines.isEmpty():
        raise ValueError(f"no sentence in {path}")
    return number_lines(lines).withColumnRenamed("line", "text")


def last_value_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One row per key: the value that comes last. Partial maxima are taken before
    the shuffle, so a key with very many duplicates sends one row per task."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``<utt_id> <text>`` lines as ``(utt_id, text)``; the last line of an id wins.

    Lines with fewer than two words are skipped.
    """
    parts = read_lines(spark, path).withColumn("parts", split_first_word(F.col("line")))
    prompts = parts.filter(F.size("parts") == 2).select(
        "file",
        "block",
        "row",
        F.col("parts")[0].alias("utt_id"),
        F.col("parts")[1].alias("text"),
    )
    return last_value_per_key(prompts, ["utt_id"], "text", ["file", "block", "row"])
