"""The folder all executors can reach, for tables a job writes and reads back."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary
    folder, which a cluster could not share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="sonoframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
