"""The registered queries of this subpackage: each applies one operator to its whole table."""

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from sonoframe.llm import (
    ann, chat, language, licenses, line_rules, mixing, near_dup, packing, periods, quality, sharding, structure, toxicity,
)
from sonoframe.llm.samples import held_out


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = Query(build, sql)
        return build

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LINE_COUNTS = r"""len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(line) - length(regexp_replace(line, '[!-/:-@\[-`{-~]', '', 'g')) AS marks,
    length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) AS separators"""

LINE_RULES_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
    SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        string_split(t, chr(10)) AS lines FROM texts),
windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)),
doubled AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT doc_id, sum(least(8, i - coalesce(before, -7))) AS n
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM doubled) GROUP BY doc_id),
lines AS (SELECT doc_id, {LINE_COUNTS}, line
    FROM (SELECT doc_id, unnest(lines) AS line FROM split)),
judged AS (
    SELECT doc_id, chars, line, chars > 0 AND (
        (n >= {line_rules.CROWDED_WORDS} AND marks * 100 > chars * {line_rules.CROWDED_PERCENT})
        OR (n >= {line_rules.LONG_LINE_WORDS} AND NOT regexp_matches(line, '{line_rules.SENTENCE_END}'))
        OR (separators >= {line_rules.MIN_SEPARATORS} AND separators * 4 >= n)
        OR (n <= {line_rules.BOILERPLATE_WORDS} AND regexp_matches(line, '{line_rules.BOILERPLATE}'))) AS fails
    FROM lines),
per_doc AS (
    SELECT doc_id, count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0) AS n_dup_lines,
        count(*) FILTER (WHERE fails) AS n_failed_lines, coalesce(sum(chars) FILTER (WHERE NOT fails), 0)::BIGINT AS kept_chars
    FROM judged GROUP BY doc_id),
base AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, n_dup_lines, n_failed_lines, kept_chars
    FROM split LEFT JOIN covered c USING (doc_id) JOIN per_doc USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
        AND kept_chars * 100 >= word_chars * {line_rules.MIN_KEPT_PERCENT} AS kept
FROM base"""


@query(LINE_RULES_SQL)
def op9_line_rules(spark, folder):
    judged = line_rules.clean_lines(read(spark, folder, "documents").select("doc_id", "text"))
    return judged.drop("text", "clean_text")


@query()
def op6_sharding(spark, folder):
    shuffled = sharding.two_pass_shuffle(read(spark, folder, "documents").select("doc_id", "text"))
    return shuffled.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def uniform_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


# The tables have no rate above 16, so one draw per document is enough here.
MIXING_SQL = f"""
WITH RECURSIVE sums AS (
    SELECT coalesce('=' || source, '-') AS s, sum(coalesce(length(text), 0) + 1)::BIGINT AS n FROM documents GROUP BY 1),
rates AS (
    SELECT s, 1.0::DOUBLE * (SELECT sum(n)::BIGINT FROM sums) / ((SELECT count(*) FROM sums) * n) AS rate FROM sums),
steps AS (
    SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
    UNION ALL
    SELECT s, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < {mixing.STEPS}),
tables AS (SELECT s, rate, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY s, rate),
drawn AS (
    SELECT d.*, t.rate, len(list_filter(t.cdf, lambda c: c <= u))::INTEGER AS n_copies
    FROM (SELECT *, coalesce('=' || source, '-') AS s, {uniform_sql("'11'", "doc_id", "'1'")} AS u FROM documents) d
    JOIN tables t USING (s)),
copies AS (SELECT *, unnest(range(0, n_copies))::INTEGER AS copy FROM drawn WHERE n_copies > 0)
SELECT doc_id, source, text, n_copies, copy, rate,
    md5('11:order:' || doc_id || chr(58) || copy) AS shuffle_key FROM copies"""


@query(MIXING_SQL)
def op7_mixing(spark, folder):
    return mixing.poisson_mix(read(spark, folder, "documents").select("doc_id", "source", "text"))


@query()
def op2_packing(spark, folder):
    return packing.pack_documents(read(spark, folder, "documents").select("doc_id", "text"), keep_ids=False).drop("ids")


@query()
def op3_language(spark, folder):
    docs = read(spark, folder, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit_on(docs.select("doc_id", "text", "lang")))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        "switched",
    )


@query()
def op8_quality(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit_on(docs, read(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


ODD_TURN = "</s>[INST] ok [/INST]"


@query()
def op10_chat(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", ODD_TURN), (-1, 1, "assistant", ODD_TURN)], turns.schema)
    return chat.read_back(chat.prefix_sequences(turns.unionByName(odd)))


@query()
def op5_near_duplicates(spark, folder):
    return near_dup.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


@query()
def op1_nearest(spark, folder):
    return ann.neighbours(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op4_licenses(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.fit_on(docs))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@F.arrow_udf(StringType())
def looped(codes: pa.Array, texts: pa.Array) -> pa.Array:
    """The text; where its document's code ends in 0, the words from some word on are replaced by a loop over the first of them."""
    made = texts.to_pylist()
    for i, code in enumerate(codes.to_pylist()):
        words = WORD.findall(made[i] or "") if code is not None and code % 10 == 0 else []
        if words:
            g, n = code // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            made[i] = " ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
    return pa.array(made, pa.string())


@query()
def op11_periodic_runs(spark, folder):
    docs = read(spark, folder, "documents")
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periods.periodic_runs(docs.select("doc_id", looped(code, F.col("text")).alias("text")))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate(
        "runs",
        F.lit(None).cast(run),
        lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


@query()
def op12_structure(spark, folder):
    turns = read(spark, folder, "conversations")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(name.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    damaged = turns.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )
    return structure.summary(structure.repaired(damaged, F.col("copies")))


@query()
def op13_toxicity(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit_on(docs, read(spark, folder, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        F.when(F.col("toxicity_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query()
def pipeline(spark, folder):
    import corpus_pipeline  # it imports the operators of this subpackage

    return corpus_pipeline.run(spark, folder)
