"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the mix over its share of the corpus, in
characters. Each document draws its number of copies from a Poisson distribution with that
mean, by inverting the distribution at a hash of its id and the seed. The copies are then put
in a global random order, by a hash too. Only built-in functions are used.

Inversion walks along a table of cumulative probabilities, which is built once per source. A
rate above ``PART`` is cut into equal parts that are drawn one by one and summed, which is
again Poisson, so no rate is capped. The copies of rows with a high rate are made in ranges of
``RANGE``, which are spread over tasks before any of them is.

Defined results: a null source is a source of its own; a null text counts one character; equal
ids draw equal counts; a source without weight (or weight 0) is left out when weights are
given; an empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sonoframe.operators.joins import lookup_join

PART = 16.0
STEPS = 96  # terms of the table: beyond them lies less than 2**-52 for a mean of 16
FEW_SOURCES = 10_000  # so many rates (under 20 MB with their tables) are broadcast, more are joined
HIGH_RATE = 512.0  # above it the copies of a row are spread over tasks
RANGE = 1024
COPY_COLUMNS = ("n_copies", "copy", "rate", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def characters(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint") + 1


def repetition_rates(
    docs: DataFrame, source: str, text: str, weights: dict[str | None, float] | None, epochs: float
) -> DataFrame:
    """``(_source, rate, _parts, _table)``, one row per source; sums over all documents.

    ``epochs`` is the size of the mix over the size of the corpus. Without ``weights``
    all sources get the same share.
    """
    sums = docs.groupBy(source_key(F.col(source)).alias("_source")).agg(F.sum(characters(F.col(text))).alias("_n"))
    total = sums.agg(F.sum("_n").alias("_all"), F.count("*").alias("_sources"))
    rates = sums.crossJoin(total)  # with one row
    if weights is None:
        rates = rates.withColumn("rate", F.lit(float(epochs)) * F.col("_all") / (F.col("_sources") * F.col("_n")))
    else:
        whole = float(sum(weights.values()))
        keys = [("-" if k is None else f"={k}", float(v) / whole) for k, v in weights.items() if v > 0]
        shares = docs.sparkSession.createDataFrame(keys, "_source string, _share double")
        rates = rates.join(shares, "_source").withColumn("rate", epochs * F.col("_all") * F.col("_share") / F.col("_n"))
    rates = rates.withColumn("_parts", F.ceil(F.col("rate") / PART).cast("bigint"))
    mean = F.col("rate") / F.col("_parts")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("table")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            (a["sum"] + a["p"] * mean / k).alias("sum"),
            F.concat(a["table"], F.array(a["sum"] + a["p"] * mean / k)).alias("table"),
        ),
        lambda a: a["table"],
    )
    return rates.select("_source", "rate", "_parts", terms.alias("_table"))


def with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Joined by source. Rates are broadcast once they are known to be few; many are joined, with hot sources dealt out."""
    if rates.select("_source").limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return docs.join(F.broadcast(rates), "_source")
    return lookup_join(docs, rates, ["_source"])


def poisson_mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = 11,
    record_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Every copy of every document as a row, in random order, with ``n_copies``, ``copy`` (from 0),
    ``rate`` and ``shuffle_key``, by which the result is sorted."""
    own = [c for c in docs.columns if c.lower() not in COPY_COLUMNS]
    docs = docs.select(*own).withColumn("_source", source_key(F.col(source)))
    rates = repetition_rates(docs, source, text, weights, epochs)
    parts = F.sequence(F.lit(1).cast("bigint"), F.col("_parts"))
    draws = F.transform(parts, lambda part: uniform(F.lit(seed), F.col(record_id), part))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("_table", lambda c: c <= u)))
    rated = with_rates(docs, rates)
    first = F.col("_range") * RANGE
    # Rates are looked at before anything is drawn, so either kind of row is drawn once.
    few = rated.filter(F.col("rate") <= HIGH_RATE).withColumn("n_copies", drawn).filter("n_copies > 0")
    few = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    many = rated.filter(F.col("rate") > HIGH_RATE).withColumn("n_copies", drawn).filter("n_copies > 0")
    ranges = F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / RANGE).cast("int"))
    many = many.withColumn("_range", F.explode(ranges)).repartition(record_id, "_range")
    many = many.withColumn("copy", F.explode(F.sequence(first, F.least(first + RANGE, F.col("n_copies")) - 1)))
    copies = few.unionByName(many.drop("_range"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(record_id).cast("string"), F.lit("")), "copy"))
    return copies.withColumn("shuffle_key", key).select(*own, *COPY_COLUMNS).orderBy("shuffle_key", "copy")
