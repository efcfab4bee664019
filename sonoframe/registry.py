"""Named corpora: which function reads them and what is known about them."""

from collections.abc import Callable, KeysView
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Corpus(NamedTuple):
    read: Callable[..., DataFrame]
    description: str
    metadata: dict[str, str]


class CorpusRegistry:
    """Every reader takes a session plus its own options and returns a lazy table."""

    def __init__(self) -> None:
        self._corpora: dict[str, Corpus] = {}

    def register(
        self, name: str, read: Callable[..., DataFrame], description: str, metadata: dict[str, str] | None = None
    ) -> None:
        if self._corpora.setdefault(name, corpus := Corpus(read, description, metadata or {})) is not corpus:
            raise ValueError(f"corpus {name!r} is registered already")

    def _get(self, name: str) -> Corpus:
        try:
            return self._corpora[name]
        except KeyError:
            raise KeyError(f"corpus {name!r} is not registered; known: {sorted(self._corpora)}") from None

    def create(self, name: str, spark: SparkSession, **options) -> DataFrame:
        return self._get(name).read(spark, **options)

    def describe(self, name: str) -> str:
        return self._get(name).description

    def metadata(self, name: str) -> dict[str, str]:
        return dict(self._get(name).metadata)

    def keys(self) -> KeysView[str]:
        return self._corpora.keys()
