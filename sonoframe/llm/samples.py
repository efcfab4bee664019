"""Bounded, repeatable samples of labelled documents to fit a classifier on."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MAX_TEXT_BYTES = 20_000  # of longer documents, a run of so many bytes at most is fitted on
LEAST_PER_LABEL = 10


def held_out(record_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(record_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def excerpt(text: Column, record_id: Column, seed: int) -> Column:
    """The text, or of a longer one a run of ``MAX_TEXT_BYTES // 4`` characters (of up to 4 bytes) from a drawn place."""
    n = MAX_TEXT_BYTES // 4
    begin = F.pmod(F.xxhash64(F.lit(seed), F.lit("excerpt"), record_id), F.greatest(F.length(text) - n, F.lit(0)) + 1) + 1
    return F.when(F.octet_length(text) <= MAX_TEXT_BYTES, text).otherwise(F.substring(text, begin.cast("int"), F.lit(n)))


def sampled_ids(
    labelled: DataFrame, record_id: str, label: str, per_label: int, full_labels: int, seed: int, apart: Callable[[Column], Column] = held_out
) -> DataFrame:
    """About ``per_label`` rows ``(record_id, label)`` of each label, of ids that are not set ``apart``. With more than
    ``full_labels`` labels, each gets fewer, but about ``LEAST_PER_LABEL`` at least.

    Rows are counted per label first; a hash of the id against the wanted share then chooses, so
    no label is gathered in one task. The sample's size does not grow with the table.
    """
    usable = labelled.filter(F.col(label).isNotNull() & F.col(record_id).isNotNull() & ~apart(F.col(record_id)))
    counts = [(r[label], r["n"]) for r in usable.groupBy(label).agg(F.count("*").alias("n")).collect()]
    wanted = per_label * min(1.0, full_labels / max(1, len(counts)))
    wanted = max(wanted, min(per_label, LEAST_PER_LABEL))
    shares = StructType([labelled.schema[label], StructField("_share", DoubleType())])
    shares = labelled.sparkSession.createDataFrame([(y, wanted / n) for y, n in counts], shares)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(record_id)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return usable.join(F.broadcast(shares), label).filter(draw < F.col("_share")).select(*labelled.columns)


def one_per_id(drawn: DataFrame, record_id: str) -> DataFrame:
    """The least row of every drawn id, so that an id which very many rows share is sent to the driver once."""
    rest = [c for c in drawn.columns if c != record_id]
    least = drawn.groupBy(record_id).agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select(record_id, *[F.col(f"_least.{c}").alias(c) for c in rest])
