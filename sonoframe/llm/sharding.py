"""Shuffled shards by a two-pass external shuffle.

Pass one scatters records uniformly into buckets small enough for memory, by seeded hashes.
Pass two shuffles each bucket by Fisher-Yates (Spark's ``shuffle`` of an array) and writes it.
Only built-in functions are used.

The law is ``key``: a record's id and the number of shards alone decide its shard. Every
shard draws a hash for the id and the largest draw wins, so one more shard only takes records
that it wins itself.

Defined results: a null text has size 1 and checksum 0; a null id is an id like any other; rows
with equal ids share a shard; an empty table gives an empty table. Rows equal in id and text
cannot be told apart and share a bucket.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_BYTES = 16 << 20  # of text in a bucket; a task holds one bucket a few times over
TASK_BUCKETS = 4


def rendezvous(record_id: Column, n_shards: int, seed: int) -> Column:
    draws = [
        F.struct(F.xxhash64(F.lit(seed), F.lit(i), record_id).alias("draw"), F.lit(i).alias("shard"))
        for i in range(n_shards)
    ]
    return F.array_max(F.array(*draws))["shard"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def buckets_needed(docs: DataFrame, text: str, n_shards: int, bucket_bytes: int) -> int:
    """Buckets per shard. One pass over the sizes of all texts."""
    total = docs.agg(F.sum(size_of(F.col(text)))).first()[0] or 0
    return max(1, -(-total // (n_shards * bucket_bytes)))


def two_pass_shuffle(
    docs: DataFrame, n_shards: int = 8, seed: int = 17, record_id: str = "doc_id", text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``, its
    shard if there were one more. Within a partition rows lie in slot order, ready to be written.

    A bucket is sorted before it is shuffled, and partitions are sorted by bucket, so a task that
    runs again after a lost executor makes the same permutation.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    n_buckets = buckets_needed(docs, text, n_shards, bucket_bytes)
    key = F.col(record_id)
    place = {
        "shard": rendezvous(key, n_shards, seed),
        "bucket": F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), key, F.col(text)), F.lit(n_buckets)),
    }
    # A few buckets to a task, however many there are.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_shards * n_buckets // TASK_BUCKETS))
    scattered = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), *[v.alias(k) for k, v in place.items()])
    scattered = scattered.repartition(tasks, "shard", "bucket")
    counts = docs.select(*[v.alias(k) for k, v in place.items()]).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    ordered = F.struct(F.col("row")[record_id].alias("id"), F.xxhash64(F.col("row")[text]).alias("h"), "row")
    gathered = (
        scattered.groupBy("shard", "bucket")
        .agg(F.collect_list(ordered).alias("rows"))
        .join(offsets, ["shard", "bucket"])
        .sortWithinPartitions("shard", "bucket")
    )
    dealt = gathered.select(
        "shard", "offset", F.posexplode(F.shuffle(F.array_sort("rows"), F.lit(seed))).alias("place", "record")
    )
    return dealt.select(
        *[F.col("record.row")[c].alias(c) for c in own],
        "shard",
        (F.col("offset") + F.col("place")).alias("slot"),
        rendezvous(F.col("record.row")[record_id], n_shards + 1, seed).alias("grown_shard"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; a file holds whole buckets in slot order."""
    shuffled.write.partitionBy("shard").parquet(path)
