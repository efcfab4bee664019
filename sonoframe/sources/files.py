"""Turning Spark's plan-time path errors into the errors callers expect."""

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def expand(path: str) -> str:
    """Expand ``~``; URIs and absolute paths pass through."""
    return os.path.expanduser(str(path))


def load_existing(load: Callable[[], DataFrame], missing: str) -> DataFrame:
    """Run a reader; a path that does not exist raises ``FileNotFoundError(missing)``."""
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(missing) from error
        raise
