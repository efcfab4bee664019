"""Live audio as a stream of chunk rows."""

from pyspark.sql import DataFrame, SparkSession

from sonoframe.schemas import CHUNK
from sonoframe.sources.files import expand


def read_pcm_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Chunk rows from a folder of Parquet files. Any other streaming source will do
    that has the same columns; arrival order does not matter."""
    reader = spark.readStream.schema(CHUNK)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(expand(path))
