"""Connected components of a table of links, by alternating large and small stars.

Every half step takes, for each node, the least of its neighbours and hangs the others on it. The
number of rounds grows with the logarithm of the longest path. Minima are aggregated before they
are shuffled, and are written to the shared folder before they are joined back, so that Spark may
split the join for a node with very many links and so that a lost executor costs no recomputation.
"""

from pyspark.sql import DataFrame, functions as F

from sonoframe.llm.stored import stored


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _hang(links: DataFrame) -> DataFrame:
    """``links`` (a, b) with the least b of each a as ``m``."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    return links.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)`` that is not its component's least node."""
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _digest(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = _hang(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        larger = stored(larger.distinct(), "large-star")
        hung = _hang(larger)
        smaller = hung.select("a", F.col("m").alias("b")).unionByName(
            hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        links = stored(smaller.distinct(), "small-star")
        after = _digest(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
