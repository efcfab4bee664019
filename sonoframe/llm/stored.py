"""Tables a job writes to the shared folder and reads back, which cuts their lineage."""

from pyspark.sql import DataFrame

from sonoframe.shared import shared_path


def stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
