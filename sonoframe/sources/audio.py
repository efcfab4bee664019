"""Recordings as tables.

A recording of any size is read in ranges: its header tells where which sample lies, so a task opens the file, seeks, and reads
the samples of a few windows. Ranges are rows of a table made from the headers, so they are planned by tasks, too, and spread like any
other rows; nothing of a file passes the driver, and no task holds more than one range.
"""

import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sonoframe.functions.arrays import quotient
from sonoframe.functions.audio import Resampler, decode_frames, decode_wave, interpolated, linear_resampler, sources_of, to_list_column
from sonoframe.schemas import AUDIO
from sonoframe.sources.files import expand, load_existing
from sonoframe.sources.listing import is_known, list_files, opened

RANGE_BYTES = 16 << 20  # of a file that are read together, or one window

AUDIO_WINDOW = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sampling_rate", T.IntegerType()),
        T.StructField("win_idx", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
    ]
)


HEADER = "path string, size bigint, rate int, width int, channels int, n_frames bigint, data_at bigint"


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every file that is named, whatever its name, and the WAV files below every folder, with their contents."""
    paths = [expand(p) for p in ([paths] if isinstance(paths, str) else paths)]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)

    def is_file(path: str) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        return files.exists(place) and files.getFileStatus(place).isFile()

    named = [p for p in paths if is_file(p)]
    folders = [p for p in paths if p not in set(named)]
    parts = [load_existing(lambda: reader.load(named), f"no audio at {', '.join(named)}")] if named else []
    if folders:
        wanted = reader.option("pathGlobFilter", "*.wav")
        parts.append(load_existing(lambda: wanted.load(folders), f"no audio at {', '.join(folders)}"))
    return reduce(DataFrame.union, [p.select("path", "content") for p in parts])


def _decoded(
    batches: Iterator[pa.RecordBatch], target_sr: int | None, resampler: Resampler
) -> Iterator[tuple[str, np.ndarray, int]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            try:
                samples, rate = decode_wave(content.as_py())
            except Exception as error:
                raise ValueError(f"cannot decode {path.as_py()}: {error}") from error
            if target_sr and rate != target_sr:
                samples, rate = resampler(samples, rate, target_sr), target_sr
            name = path.as_py()
            yield name.removeprefix("file:") if name.startswith("file:/") else name, samples, rate


def read_audio(
    spark: SparkSession,
    paths: str | list[str],
    target_sr: int | None = None,
    resampler: Resampler = linear_resampler,
) -> DataFrame:
    """PCM WAV files (or folders of them) as mono float32: ``(path, sampling_rate,
    n_samples, array)``. A missing path and an undecodable file are errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, samples, rate in _decoded(batches, target_sr, resampler):
            columns = [
                pa.array([path]),
                pa.array([rate], pa.int32()),
                pa.array([len(samples)], pa.int64()),
                to_list_column([samples]),
            ]
            yield pa.RecordBatch.from_arrays(columns, AUDIO.names)

    return _files(spark, paths).mapInArrow(run, AUDIO)


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, size, rate, width, channels, n_frames, data_at)`` of all recordings; only headers are read. A header that
    promises more than the file holds counts as far as the file goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                system, inner, _ = opened(path)
                try:
                    with system.open_input_file(inner) as file, wave.open(file) as reader:
                        width, channels, n = reader.getsampwidth(), reader.getnchannels(), reader.getnframes()
                        reader.rewind()
                        reader.readframes(1)
                        at = file.tell() - (width * channels if n else 0)
                        n = min(n, (size - at) // (width * channels))
                        rows.append((path, size, reader.getframerate(), width, channels, n, at))
                except Exception as error:
                    raise ValueError(f"cannot decode {path}: {error}") from error
            names = ["path", "size", "rate", "width", "channels", "n_frames", "data_at"]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    paths = [paths] if isinstance(paths, str) else paths
    return list_files(spark, paths, ".wav", f"no audio at {', '.join(paths)}").mapInArrow(run, HEADER)


def read_audio_windows(
    spark: SparkSession,
    paths: str | list[str],
    chunk_s: float = 30.0,
    stride_s: float | None = None,
    target_sr: int | None = None,
    resampler: Resampler = linear_resampler,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The same recordings already cut: one row per window, the last one as long as what
    is left. ``chunk_s`` 0 leaves recordings whole.

    A long recording is read in ranges by many tasks; only numbers are shuffled. Another ``resampler`` than the linear one
    needs a recording as a whole, as does a path that only Spark can open: then a file is read by one task.
    """
    if stride_s is not None and (stride_s <= 0 or stride_s > chunk_s):
        raise ValueError("the hop must be positive and not exceed the window length")
    named = [expand(p) for p in ([paths] if isinstance(paths, str) else paths)]
    if resampler is not linear_resampler or not all(map(is_known, named)):
        return _windows_of_whole_files(spark, named, chunk_s, stride_s, target_sr, resampler)
    rate = F.lit(target_sr) if target_sr else F.col("rate")
    total = F.when(F.col("rate") == rate, F.col("n_frames")).otherwise(quotient(F.col("n_frames") * rate + F.col("rate") - 1, F.col("rate")))
    headers = read_headers(spark, named).withColumns({"to_rate": rate.cast("int"), "total": total}).filter("total > 0")
    chunk = F.when(F.lit(chunk_s) * rate >= 1, (F.lit(float(chunk_s)) * rate).cast("bigint")).otherwise(F.col("total"))
    stride = (F.lit(float(stride_s)) * rate).cast("bigint") if stride_s else F.col("chunk")
    sized = headers.withColumn("chunk", chunk).withColumn("stride", stride)
    done = F.when(F.col("total") >= F.col("chunk"), quotient(F.col("total") - F.col("chunk"), F.col("stride")) + 1).otherwise(0)
    counted = sized.withColumn("n_win", F.when(done * F.col("stride") < F.col("total"), done + 1).otherwise(done).cast("bigint"))
    # So many windows to a range, and so many ranges to a recording.
    bytes_of = F.col("stride") * F.col("width") * F.col("channels") * (F.col("rate") / F.col("to_rate"))
    per_range = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / bytes_of)).cast("bigint")
    ranges = counted.withColumn("per_range", per_range).withColumn(
        "range", F.explode(F.sequence(F.lit(0).cast("bigint"), quotient(F.col("n_win") - 1, F.col("per_range"))))
    )
    first = F.col("range") * F.col("per_range")
    placed = ranges.withColumns({"first": first, "last": F.least(first + F.col("per_range"), F.col("n_win"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _range_windows(row)

    # As many tasks as the session asks for: by their size the rows would all be given to one.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "path", "range").mapInArrow(run, AUDIO_WINDOW)


def _range_windows(row: dict) -> Iterator[pa.RecordBatch]:
    chunk, stride, total, frame = row["chunk"], row["stride"], row["total"], row["width"] * row["channels"]
    rates = row["rate"], row["to_rate"]
    begin, end = row["first"] * stride, min((row["last"] - 1) * stride + chunk, total)
    low, high = sources_of(begin, end, row["n_frames"], *rates)
    system, inner, _ = opened(row["path"])
    with system.open_input_file(inner) as file:
        file.seek(row["data_at"] + low * frame)
        raw = file.read((high - low) * frame)
    if len(raw) != (high - low) * frame:
        raise ValueError(f"cannot decode {row['path']}: it ends early")
    samples = decode_frames(raw, row["width"], row["channels"])
    if rates[0] != rates[1]:
        samples = interpolated(samples, low, row["n_frames"], begin, end, *rates)
    for k in range(row["first"], row["last"]):
        start = k * stride
        yield _window(row["path"], row["to_rate"], k, start, samples[start - begin : start - begin + chunk])


def _window(path: str, rate: int, k: int, start: int, piece: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([rate], pa.int32()), *[pa.array([v], pa.int64()) for v in (k, start, start + len(piece))]]
    return pa.RecordBatch.from_arrays([pa.array([path]), *numbers, to_list_column([piece])], AUDIO_WINDOW.names)


def _windows_of_whole_files(
    spark: SparkSession, paths: list[str], chunk_s: float, stride_s: float | None, target_sr: int | None, resampler: Resampler
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, samples, rate in _decoded(batches, target_sr, resampler):
            chunk = int(chunk_s * rate) or len(samples)
            stride = int(stride_s * rate) if stride_s else chunk
            done = (len(samples) - chunk) // stride + 1 if len(samples) >= chunk > 0 else 0
            n_win = done + (done * stride < len(samples))
            for k in range(n_win):
                yield _window(path, rate, k, k * stride, samples[k * stride : k * stride + chunk])

    return _files(spark, paths).mapInArrow(run, AUDIO_WINDOW)
