"""Where results go. Each task writes the files of the splits it holds; a split
without rows writes nothing."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def write_processed(df: DataFrame, path: str) -> None:
    """Canonical table, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_manifest_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8 as it is, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_manifest_arrays(df: DataFrame, path: str) -> None:
    """JSON arrays of objects, indented by two; each task writes one array to a file of its own."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            if batch.num_rows:
                lines = [f"{before if i == 0 else ','}\n  {record}" for i, record in enumerate(batch.column(0).to_pylist())]
                before = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])

    objects = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    objects.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def write_transcripts(df: DataFrame, path: str, text_only: bool = False) -> None:
    """Transcripts with everything known about them, or the text alone, one per line."""
    if text_only:
        one_line = F.regexp_replace("text", r"[\r\n]+", " ")
        df.select(one_line.alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").parquet(path)


NO_DATA_RUNS = "spark.sql.streaming.noDataMicroBatches.enabled"  # a fixed value: Spark's name of the setting


def write_messages(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append the messages of a stream to a Parquet table; returns the running query.

    A run over what is available ends when that is read. Its timers wait for rows of the next run: with empty
    batches, which processing-time timers ask for without end, it would never stop.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if not trigger:
        return writer.start(path)
    conf = stream.sparkSession.conf
    before = conf.get(NO_DATA_RUNS, "true")
    if trigger.get("availableNow"):
        conf.set(NO_DATA_RUNS, "false")
    try:
        return writer.trigger(**trigger).start(path)
    finally:
        conf.set(NO_DATA_RUNS, before)
