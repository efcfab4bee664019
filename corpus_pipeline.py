"""The corpus pipeline: raw documents to packed training sequences, one stage after the other.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read back as the
next stage's ``docs``. All but the last return the columns of ``documents``.

Defined results: rows that share an id, or have none, are documents of their own at every stage; an empty table
gives an empty table. A document that is repeated by the mix is packed once per copy.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoframe.llm import language, line_rules, mixing, near_dup, packing
from sonoframe.llm.stored import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_CERTAINTY = 0.5  # mean, over a document's words, of the probability of each word's own best language
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told go on; those without letters or of unclear words are rejected."""
    model = language.fit_on(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs.select(*COLUMNS), model, certain="_certain")
    passes = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("_certain") >= LEAST_CERTAINTY)
    return found.filter(passes).select(*COLUMNS)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail."""
    judged = line_rules.clean_lines(docs.select(*COLUMNS)).filter("kept")
    text = F.col("clean_text")
    return judged.withColumns({"text": text, "n_chars": F.length(text).cast("bigint")}).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (null ids last).

    Rows are told apart by a number of their own, so texts that share an id, or have none, are compared like all others.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    named = rows.select("_row", "doc_id").join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = named.groupBy("component_id").agg(F.min(order).alias("first"))
    kept = stored(first.select(F.col("first._row").alias("_row")), "kept")
    # One way of joining at every size: a broadcast that only small tables get would make the shuffle grow faster than the input.
    return rows.join(kept.hint("merge"), "_row", "left_semi").select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with equal shares of all sources, as long as its input, in random order."""
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in windows of 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), keep_ids=False).drop("ids")


STAGES = [
    ("language", identified_language),
    ("line_rules", clean_lines),
    ("near_duplicates", one_of_each),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# Languages are told by a trained model, which SQL cannot express; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
