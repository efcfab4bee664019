"""JSON manifests: one object per line, or arrays of objects, in any layout."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sonoframe.functions.text import strip
from sonoframe.operators.columns import union_splits
from sonoframe.schemas import MANIFEST
from sonoframe.sources.files import expand
from sonoframe.sources.json_records import holds_arrays, json_objects


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """One manifest with a declared schema, a file or a folder of files of either kind. A malformed record
    fails the job; no record is left out."""
    path = expand(path)
    if not holds_arrays(spark, path):
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return json_objects(spark, path).select(record.alias("record")).select("record.*")


def manifest_keys(spark: SparkSession, path: str) -> set[str]:
    """Distinct top-level keys of a manifest (a handful, whatever its size)."""
    path = expand(path)
    if holds_arrays(spark, path):
        objects = json_objects(spark, path)
    else:
        objects = spark.read.text(path).filter(strip(F.col("value")) != "")
    found = objects.select(F.explode(F.json_object_keys("value")).alias("key"))
    return {row["key"] for row in found.distinct().collect()}


def read_manifest_splits(
    spark: SparkSession, manifests: dict[str, str], schema: T.StructType = MANIFEST
) -> dict[str, DataFrame]:
    """One lazy table per split."""
    if not manifests:
        raise ValueError("give at least one manifest")
    return {split: read_manifest(spark, path, schema) for split, path in manifests.items()}


def read_manifests(
    spark: SparkSession, manifests: dict[str, str], schema: T.StructType = MANIFEST
) -> DataFrame:
    """All splits as one table with a ``split`` column."""
    return union_splits(read_manifest_splits(spark, manifests, schema))
