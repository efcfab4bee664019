"""Folder trees listed by tasks.

A round lists the folders that the round before has found, one folder to a row and spread over all tasks; its files are
part of the result and its sub-folders are the next round. The driver learns how many folders are left and nothing else, so a
corpus may hold any number of files. There are as many rounds as the tree is deep.

Tasks list through Arrow's file systems (mounted folders, HDFS, object stores). Where only Spark knows how to open a path, its own
listing is used, which keeps the state of every file on the driver.
"""

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoframe.shared import shared_path
from sonoframe.sources.files import expand, load_existing

FILES = "path string, size bigint"
_LISTED = "path string, size bigint, is_folder boolean"
FOLDERS_PER_TASK = 64
DEEPEST = 1000  # rounds; a deeper tree is a link that leads back


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what leads its paths elsewhere (nothing for mounted folders)."""
    local = re.sub("^file:/+", "/", path)
    if "://" not in local:
        return fs.LocalFileSystem(), os.path.realpath(local), ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path.removesuffix(inner)


def is_known(path: str) -> bool:
    """Whether tasks can open a path without Spark."""
    try:
        opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def is_hidden(name: str) -> bool:
    """Spark's rule for files that are not data."""
    return name.startswith((".", "_")) and not (name.startswith("_") and "=" in name)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            system, inner, prefix = opened(folder)
            found = [f for f in system.get_file_info(fs.FileSelector(inner)) if not is_hidden(f.base_name)]
            columns = [
                pa.array([prefix + f.path for f in found], pa.string()),
                pa.array([f.size or 0 for f in found], pa.int64()),
                pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["path", "size", "is_folder"])


def list_files(spark: SparkSession, paths: str | list[str], suffix: str = "", missing: str | None = None) -> DataFrame:
    """``(path, size)`` of every named file, whatever its name, and of all files below the folders whose name ends in ``suffix``.
    A path that does not exist raises ``FileNotFoundError``."""
    paths = [expand(p) for p in ([paths] if isinstance(paths, str) else paths)]
    if not all(is_known(p) for p in paths):
        return _listed_by_spark(spark, paths, suffix, missing)
    named, folders = [], []
    for path in paths:
        system, inner, prefix = opened(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(missing or f"no such path: {path}")
        if info.type == fs.FileType.Directory:
            folders.append((prefix + inner.rstrip("/"),))
        else:
            named.append((prefix + inner, info.size or 0))
    base, count, rounds = shared_path(spark, "listing"), len(folders), 0
    frontier = spark.createDataFrame(folders, "path string")
    while count:
        if rounds > DEEPEST:
            raise RuntimeError(f"folders nest more than {DEEPEST} deep below {', '.join(paths)}")
        place = f"{base}/round={rounds}"
        spread = frontier.repartition(max(1, -(-count // FOLDERS_PER_TASK)), "path") if count > 1 else frontier
        spread.mapInArrow(_list, _LISTED).write.parquet(place)
        frontier = spark.read.schema(_LISTED).parquet(place).filter("is_folder").select("path")
        count, rounds = frontier.count(), rounds + 1
    files = spark.createDataFrame(named, FILES)
    if rounds:
        every = spark.read.schema(_LISTED).parquet(*[f"{base}/round={k}" for k in range(rounds)])
        below = every.filter(~F.col("is_folder") & F.col("path").endswith(suffix)).select("path", "size")
        files = below.union(files) if named else below
    return files


def _listed_by_spark(spark: SparkSession, paths: list[str], suffix: str, missing: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    found = load_existing(lambda: reader.load(paths), missing or f"no such path: {', '.join(paths)}")
    return found.select("path", F.col("length").alias("size"))
