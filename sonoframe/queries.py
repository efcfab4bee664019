"""Registered queries over the benchmark tables, each beside the SQL that must agree.

Texts, numbers and arrays of the given tables stand in for transcripts, sample
counts and waveforms. Every query reads whole tables.
"""

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sonoframe.functions import arrays, audio, text
from sonoframe.functions.recognise import hears_batches, transcribe_windows
from sonoframe.operators import batches, columns, concat, joins, labels, lexicon, metrics, running, windows
from sonoframe.plans import manifests as manifest_jobs, prepare as prepare_jobs, training, transcribe
from sonoframe.schemas import CHUNK as CHUNK_SCHEMA, VOCAB
from sonoframe.shared import shared_path
from sonoframe.sinks import tables, waves
from sonoframe.sources import corpora, lines, manifests, stream
from sonoframe.streaming import rolling


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


def long(value: Column) -> Column:
    return value.cast("bigint")


# --- shared pieces: languages as splits, sources as speakers ------------------

SPLIT = "CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' WHEN 'de' THEN 'test' ELSE 'other' END"


def norm_sql(value: str) -> str:
    spaced = f"""regexp_replace(lower({value}), '[.,?!:\\-;()\\[\\]{{}}"'']', ' ', 'g')"""
    return f"trim(regexp_replace(nfc_normalize({spaced}), '[\\s\\x{{a0}}]+', ' ', 'g'))"


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a column corpus: ``split, audio, sentence, speaker_id`` and more."""
    return read(spark, folder, "documents").select(
        F.expr(SPLIT).alias("split"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "doc_id", F.lit(".wav")).alias("audio"),
        F.col("text").alias("sentence"),
        F.col("source").alias("speaker_id"),
        F.col("lang").alias("client_id"),
        F.col("n_chars").cast("int").alias("up_votes"),
        F.lit(0).alias("down_votes"),
        "doc_id",
    )


CORPUS_SQL = f"""SELECT {SPLIT} AS split, '/corpus/' || source || '/' || doc_id || '.wav' AS audio,
    text AS sentence, source AS speaker_id, lang AS client_id, n_chars::INTEGER AS up_votes, 0 AS down_votes
    FROM documents"""


def stored_corpus(spark: SparkSession, folder: str) -> str:
    path = shared_path(spark, "corpus")
    corpus(spark, folder).write.partitionBy("split").parquet(path)
    return path


# --- text ---------------------------------------------------------------------


@query(f"SELECT doc_id, {norm_sql('text')} AS transcript FROM documents")
def normalize_transcripts(spark, folder):
    docs = read(spark, folder, "documents")
    return columns.map_transcript(docs, "text", "transcript").select("doc_id", "transcript")


# The same texts with accents taken apart and no-break spaces, which the tables lack.
DECOMPOSED = {"é": "é", "è": "è", "ê": "ê", "ç": "ç", "ü": "ü", "ñ": "ñ", " ": " "}


def decomposed_sql(value: str) -> str:
    for whole, parts in DECOMPOSED.items():
        value = f"replace({value}, '{whole}', '{parts}')"
    return value


@query(f"SELECT doc_id, {norm_sql(decomposed_sql('text'))} AS transcript FROM documents")
def normalize_decomposed(spark, folder):
    taken_apart = F.col("text")
    for whole, parts in DECOMPOSED.items():
        taken_apart = F.replace(taken_apart, F.lit(whole), F.lit(parts))
    docs = read(spark, folder, "documents").select("doc_id", taken_apart.alias("sentence"))
    return columns.map_transcript(docs).select("doc_id", "transcript")


@query(
    r"""SELECT item_id, trim(' ' || text || ' ') AS stripped, lower(text) AS lowered,
        regexp_replace(text, '[.,?!:\-;()\[\]{}"'']', ' ', 'g') AS unpunctuated,
        nfc_normalize(text) AS composed, regexp_replace(text, '\s+', ' ', 'g') AS collapsed,
        coalesce(CASE WHEN length(text) % 2 = 0 THEN trim(text) END, '') AS defaulted FROM benchmark"""
)
def text_steps(spark, folder):
    t = F.col("text")
    return read(spark, folder, "benchmark").select(
        "item_id",
        text.strip(F.concat(F.lit(" "), t, F.lit(" "))).alias("stripped"),
        text.lower(t).alias("lowered"),
        text.punctuation_to_space(t).alias("unpunctuated"),
        text.nfc(t).alias("composed"),
        text.collapse_whitespace(t).alias("collapsed"),
        text.default_text(F.when(F.length(t) % 2 == 0, t)).alias("defaulted"),
    )


@query(
    r"""SELECT doc_id, regexp_extract(trim(text), '^(\S+)\s+(?s:.+)$', 1) AS utt_id,
        md5(regexp_extract(trim(text), '^\S+\s+((?s:.+))$', 1)) AS rest_md5
        FROM documents WHERE regexp_matches(trim(text), '^\S+\s+\S')"""
)
def first_words(spark, folder):
    parts = read(spark, folder, "documents").select("doc_id", text.split_first_word(F.col("text")).alias("p"))
    return parts.filter(F.size("p") == 2).select(
        "doc_id", F.col("p")[0].alias("utt_id"), F.md5(F.col("p")[1]).alias("rest_md5")
    )


@query(
    """SELECT event_id, printf('[%.2f-%.2f] ', coalesce(CASE WHEN event_type <> 'error' THEN value / 100 END, 0),
        coalesce(value / 8, 0)) || event_type AS label FROM events"""
)
def segment_labels(spark, folder):
    start = F.when(F.col("event_type") != "error", F.col("value") / 100)
    return read(spark, folder, "events").select(
        "event_id", text.segment_label(start, F.col("value") / 8, F.concat(F.lit(" "), "event_type")).alias("label")
    )


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '^(.+)\.[^.]+$', 1)
        ELSE name END AS stem, CASE WHEN url LIKE 'https://%' THEN string_split(substr(url, 9), '/')[1] END AS first_part
        FROM (SELECT page_id, url, list_last(string_split(url, '/')) AS name FROM pages)"""
)
def path_parts(spark, folder):
    url = F.col("url")
    return read(spark, folder, "pages").select(
        "page_id", text.path_stem(url).alias("stem"), text.first_part_below(url, "https://").alias("first_part")
    )


# --- corpus preparation ---------------------------------------------------------


@query(
    f"""SELECT split, count(*)::BIGINT AS utterances, sum(len(string_split(transcript, ' ')))::BIGINT AS words
        FROM (SELECT split, {norm_sql('sentence')} AS transcript FROM ({CORPUS_SQL}))
        WHERE split <> 'other' GROUP BY split"""
)
def prepared_corpus(spark, folder):
    """Union of splits, split choice, empty filter, normaliser, pruning, counts."""
    table = corpus(spark, folder)
    names = ("train", "validation", "test", "other")
    united = columns.union_splits({n: table.filter(F.col("split") == n).drop("split") for n in names})
    kept = columns.select_splits(united, columns.crowd_splits(include_test=True))
    ready = columns.map_transcript(columns.drop_empty_transcripts(kept))
    pruned = columns.prune_columns(ready)
    return pruned.groupBy("split").agg(
        F.count("*").alias("utterances"), F.sum(long(F.size(F.split("transcript", " ")))).alias("words")
    )


@query(
    """SELECT doc_id, sentence FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN source = 'src3' THEN ''
        WHEN source = 'src5' THEN '  ' ELSE text END AS sentence FROM documents)
        WHERE sentence IS NOT NULL AND length(sentence) > 0"""
)
def drop_empty(spark, folder):
    sentence = (
        F.when(F.col("lang") == "de", F.lit(None))
        .when(F.col("source") == "src3", "")
        .when(F.col("source") == "src5", "  ")
        .otherwise(F.col("text"))
    )
    docs = read(spark, folder, "documents").select("doc_id", sentence.alias("sentence"))
    return columns.drop_empty_transcripts(docs)


@query(f"SELECT split, count(*)::BIGINT AS n FROM ({CORPUS_SQL}) WHERE split IN ('train', 'validation') GROUP BY split")
def split_select(spark, folder):
    kept = columns.select_splits(corpus(spark, folder), columns.crowd_splits(include_test=False))
    return kept.groupBy("split").agg(F.count("*").alias("n"))


@query(
    f"""SELECT CASE split WHEN 'train' THEN 'train' ELSE 'evaluation' END AS use, audio FROM ({CORPUS_SQL})
        WHERE split IN ('train', 'validation')"""
)
def eval_split(spark, folder):
    train, evaluation = columns.select_eval_split(corpus(spark, folder))
    return train.select(F.lit("train").alias("use"), "audio").unionByName(
        evaluation.select(F.lit("evaluation").alias("use"), "audio")
    )


@query(f"SELECT DISTINCT split FROM ({CORPUS_SQL})")
def list_splits(spark, folder):
    return metrics.list_splits(corpus(spark, folder))


def renamed(spark, folder, speaker_everywhere: bool) -> DataFrame:
    docs = read(spark, folder, "documents").select(
        F.col("doc_id").alias("audio_filepath"), "text", F.col("source").alias("speaker"), "lang"
    )
    english = docs.filter("lang = 'en'")
    other = docs.filter("lang <> 'en'")
    splits = {"train": english, "test": other if speaker_everywhere else other.drop("speaker")}
    splits = columns.rename_canonical(splits, speaker_column="speaker", rename_text=True)
    return columns.union_splits({name: columns.prune_columns(df) for name, df in splits.items()})


@query(
    """SELECT CASE lang WHEN 'en' THEN 'train' ELSE 'test' END AS split, doc_id AS audio, text AS transcript,
        source AS speaker_id FROM documents"""
)
def canonical_columns(spark, folder):
    return renamed(spark, folder, speaker_everywhere=True)


@query("SELECT CASE lang WHEN 'en' THEN 'train' ELSE 'test' END AS split, doc_id AS audio, text AS transcript FROM documents")
def canonical_columns_speaker_missing(spark, folder):
    """One split lacks the speaker: none is renamed, and pruning removes the old name."""
    return renamed(spark, folder, speaker_everywhere=False)


@query("SELECT doc_id, n_chars * 2 AS doubled FROM documents")
def replaced_columns(spark, folder):
    return columns.replace_columns(
        read(spark, folder, "documents"), doc_id=F.col("doc_id"), doubled=F.col("n_chars") * 2
    )


@query(
    f"""SELECT split, audio, {norm_sql('sentence')} AS transcript, speaker_id FROM ({CORPUS_SQL})
        WHERE split IN ('train', 'test')"""
)
def vivos_table(spark, folder):
    return corpora.read_vivos_table(spark, stored_corpus(spark, folder))


@query(
    f"""SELECT split, audio, {norm_sql('sentence')} AS transcript, client_id, up_votes, down_votes
        FROM ({CORPUS_SQL}) WHERE split <> 'other'"""
)
def common_voice_table(spark, folder):
    return corpora.read_common_voice(spark, stored_corpus(spark, folder))


@query(
    f"""SELECT split, audio, {norm_sql('sentence')} AS transcript, speaker_id FROM ({CORPUS_SQL})
        WHERE split IN ('train', 'test')"""
)
def processed_round_trip(spark, folder):
    """The whole preparation job: registry, reader, writer, reader of prepared tables."""
    target = shared_path(spark, "prepared")
    prepare_jobs.prepare(spark, "vivos", target, path=stored_corpus(spark, folder))
    return corpora.read_processed(spark, target)


def stored_manifests(spark, folder) -> dict[str, str]:
    target = shared_path(spark, "manifest")
    records = corpus(spark, folder).select(
        F.col("audio").alias("audio_filepath"), F.col("sentence").alias("text"), "speaker_id", "split"
    )
    tables.write_manifest_jsonl(records, target)
    return {name: f"{target}/split={name}" for name in ("train", "validation", "test", "other")}


@query(f"SELECT split, audio AS audio_filepath, sentence AS text, speaker_id FROM ({CORPUS_SQL})")
def manifest_round_trip(spark, folder):
    return manifests.read_manifests(spark, stored_manifests(spark, folder))


NESTED_RECORD = T.StructType().add("audio_filepath", "string").add("text", "string").add("speaker_id", "string").add(
    "extra", T.StructType().add("n_chars", "long").add("notes", T.ArrayType(T.StructType().add("mark", "string").add("lang", "string")))
)


@query(
    """SELECT doc_id::VARCHAR AS audio_filepath, text, source AS speaker_id, n_chars, lang, ' }, {"\\ ]' AS mark FROM documents"""
)
def array_manifest_round_trip(spark, folder):
    """Arrays of nested objects, whose texts hold what looks like the end of an object."""
    target = shared_path(spark, "array-manifest")
    mark = F.lit(' }, {"\\ ]')
    extra = F.struct("n_chars", F.array(F.struct(mark.alias("mark"), "lang")).alias("notes"))
    records = read(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("audio_filepath"), "text", F.col("source").alias("speaker_id"), extra.alias("extra")
    )
    tables.write_manifest_arrays(records, target)
    note = F.col("extra.notes")[0]
    return manifests.read_manifest(spark, target, NESTED_RECORD).select(
        "audio_filepath", "text", "speaker_id", "extra.n_chars", note["lang"].alias("lang"), note["mark"].alias("mark")
    )


@query(f"SELECT split, audio, {norm_sql('sentence')} AS transcript, speaker_id FROM ({CORPUS_SQL})")
def custom_corpus(spark, folder):
    return prepare_jobs.registry.create("custom", spark, manifests=stored_manifests(spark, folder))


@query("SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def transcript_text_round_trip(spark, folder):
    """Transcripts as plain text, one per line, led by their id."""
    target = shared_path(spark, "transcripts")
    docs = read(spark, folder, "documents")
    tables.write_transcripts(docs.select(F.concat_ws("\t", "doc_id", "text").alias("text")), target, text_only=True)
    parts = F.split("value", "\t", 2)
    return spark.read.text(target).select(long(parts[0]).alias("doc_id"), parts[1].alias("text"))


# --- lines --------------------------------------------------------------------------

LINES_SQL = """SELECT doc_id, u.i AS i, u.line AS line FROM (SELECT doc_id,
    unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': trim(x)})) AS u FROM documents)
    WHERE u.line <> ''"""


def stored_lines(spark, folder) -> str:
    """Document lines as text files, ``<doc_id> <line>``, with blank lines in between."""
    target = shared_path(spark, "lines")
    cut = read(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    told = cut.filter(text.strip(F.col("line")) != "")
    told.select(F.concat("doc_id", F.lit("  "), "line", F.lit("\n \t ")).alias("value")).write.text(target)
    return target


@query(
    f"""SELECT doc_id, n, format('utt_{{:05d}}.wav', n) AS wave, line AS text FROM
        (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ({LINES_SQL}))"""
)
def sentence_numbering(spark, folder):
    """Numbers are given per file; a document's lines are neighbours in a file, so its
    numbers are consecutive and are shown counted from its first line."""
    numbered = lines.read_sentences(spark, stored_lines(spark, folder))
    parts = numbered.withColumn("p", text.split_first_word(F.col("text"))).select(
        long(F.col("p")[0]).alias("doc_id"), "n", F.col("p")[1].alias("text")
    )
    first = parts.groupBy("doc_id").agg(F.min("n").alias("first"))
    own = F.col("n") - F.col("first") + 1
    return parts.join(first, "doc_id").select("doc_id", own.alias("n"), text.wave_name(own).alias("wave"), "text")


@query(f"SELECT doc_id::VARCHAR AS utt_id, arg_max(line, i) AS text FROM ({LINES_SQL}) GROUP BY doc_id")
def prompt_lines(spark, folder):
    """Prompt files in which every id occurs many times; its last line counts."""
    return lines.read_prompts(spark, stored_lines(spark, folder))


@query(
    """SELECT '/out/train/audio/' || format('utt_{:05d}.wav', item_id + 1) AS audio_filepath, text, 'train' AS split
        FROM benchmark"""
)
def sentence_manifest(spark, folder):
    numbered = read(spark, folder, "benchmark").select((F.col("item_id") + 1).alias("n"), "text")
    manifest = manifest_jobs.sentence_manifest(numbered, "/out/train/audio", "train")
    target = shared_path(spark, "sentence-manifest")
    tables.write_manifest_jsonl(manifest, target)
    return spark.read.schema("audio_filepath string, text string, split string").json(target)


# --- corpus joins ----------------------------------------------------------------------


def waves_and_prompts(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Documents as waves; labels, as prompts, cover some of them."""
    waves = read(spark, folder, "documents").select(
        F.col("doc_id").alias("utt_id"), "source", F.expr(SPLIT).alias("split")
    )
    prompts = read(spark, folder, "labels").select(
        F.col("doc_id").alias("utt_id"), F.concat_ws(" ", "quality", "toxic").alias("text")
    )
    return waves, prompts


@query(
    """SELECT doc_id AS utt_id, source, quality || ' ' || toxic AS text FROM documents JOIN labels USING (doc_id)"""
)
def manifest_join(spark, folder):
    waves, prompts = waves_and_prompts(spark, folder)
    return joins.join_prompts(waves, prompts).select("utt_id", "source", "text")


@query("SELECT doc_id AS utt_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def manifest_unmatched(spark, folder):
    waves, prompts = waves_and_prompts(spark, folder)
    return joins.unmatched_waves(waves, prompts).select("utt_id", "source")


@query(
    f"""SELECT coalesce({SPLIT}, 'total') AS split, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id)
        GROUP BY ROLLUP (lang) HAVING lang IS NOT NULL
        UNION ALL SELECT 'total', count(*)::BIGINT FROM documents JOIN labels USING (doc_id)"""
)
def manifest_counts(spark, folder):
    matched = joins.join_prompts(*waves_and_prompts(spark, folder))
    counts = metrics.require_rows(metrics.count_splits(matched))
    return counts.select(F.coalesce("split", F.lit("total")).alias("split"), "n")


@query("SELECT user_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def last_wins(spark, folder):
    return lines.last_value_per_key(read(spark, folder, "events"), ["user_id"], "props", ["event_id"])


@query("SELECT event_type AS run, arg_min(event_id, value) AS epoch, min(value) AS wer FROM events GROUP BY event_type")
def best_by_metric(spark, folder):
    table = read(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("wer")
    )
    return metrics.best_checkpoint(table)


# --- word error rate: a user's turn against the answer that follows it -----------------------

PAIRS_SQL = f"""SELECT u.conv_id, u.turn, string_split({norm_sql('u.text')}, ' ') AS r,
    CASE WHEN a.text IS NULL THEN [] ELSE string_split({norm_sql('a.text')}, ' ') END AS h
    FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""
# Edit distance row by row: each step turns the distances of i words into those of i + 1.
EDITS_SQL = f"""WITH RECURSIVE pairs AS MATERIALIZED ({PAIRS_SQL}),
    steps(conv_id, turn, i, d) AS (
      SELECT conv_id, turn, 0, range(0, len(h) + 1) FROM pairs
      UNION ALL
      SELECT s.conv_id, s.turn, s.i + 1, list_reduce(
        list_transform(p.h, lambda x, j: least(s.d[j + 1] + 1, s.d[j] + CASE WHEN x = p.r[s.i + 1] THEN 0 ELSE 1 END)),
        lambda row, c: list_append(row, least(c, row[len(row)] + 1)), [(s.i + 1)::BIGINT])
      FROM steps s JOIN pairs p USING (conv_id, turn) WHERE s.i < len(p.r))
    SELECT conv_id, turn, d[len(d)]::BIGINT AS edits, len(r)::BIGINT AS ref_words
    FROM steps JOIN pairs USING (conv_id, turn) WHERE i = len(r)"""


def turn_pairs(spark, folder) -> tuple[DataFrame, DataFrame]:
    turns = read(spark, folder, "conversations").withColumn("text", text.normalize_transcript(F.col("text")))
    asked = turns.filter("role = 'user'").select("conv_id", "turn", "text")
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return asked, answered


@query(EDITS_SQL)
def word_edits(spark, folder):
    pairs = joins.pair_hypotheses(*turn_pairs(spark, folder), ["conv_id", "turn"], "text", "text")
    return metrics.score_pairs(pairs).select(
        "conv_id", "turn", long(F.col("edits")).alias("edits"), long(F.col("ref_words")).alias("ref_words")
    )


@query(f"SELECT round(sum(edits) / sum(ref_words), 9) AS wer FROM ({EDITS_SQL})")
def corpus_wer(spark, folder):
    score = training.evaluate_wer(*turn_pairs(spark, folder), ["conv_id", "turn"])
    return score.select(F.round("wer", 9).alias("wer"))


# --- ordered concatenation ------------------------------------------------------------------

PIECE = "CASE role WHEN 'system' THEN NULL ELSE ' ' || text || ' ' END"


def segments(spark, folder, mode: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.expr(PIECE).alias("text"))
    return concat.concat_segments(turns, ["conv_id"], "turn", mode=mode)


@query(
    f"SELECT conv_id, string_agg(trim(coalesce({PIECE}, '')), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
)
def concat_segments_strip_each(spark, folder):
    return segments(spark, folder, "strip_each")


@query(
    f"SELECT conv_id, trim(string_agg(coalesce({PIECE}, ''), ' ' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id"
)
def concat_segments_strip_ends(spark, folder):
    return segments(spark, folder, "strip_ends")


@query(
    f"""SELECT conv_id, string_agg(trim({PIECE}), ' ' ORDER BY turn) AS text FROM conversations
        WHERE trim(coalesce({PIECE}, '')) <> '' GROUP BY conv_id"""
)
def concat_segments_skip_empty(spark, folder):
    return segments(spark, folder, "skip_empty")


# --- windows: users as sessions, events as chunks of floor(value * 10) samples -----------------

CHUNK, STRIDE, RATE = 500, 100, 100  # 5 s windows every second at 100 Hz
DONE = "CASE WHEN {n} < 500 THEN 0 ELSE ({n} - 500) // 100 + 1 END"
CHUNKS_SQL = """SELECT user_id, event_id, length(event_type) AS level,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, floor(value * 10)::BIGINT AS n,
    (sum(floor(value * 10)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS upto FROM events"""
WINDOWS_SQL = f"""SELECT user_id, seq, unnest(range({DONE.format(n='(upto - n)')}, {DONE.format(n='upto')})) AS win_idx
    FROM ({CHUNKS_SQL})"""
LEFT_SQL = f"""SELECT user_id, done AS win_idx, done * 100 AS start, total AS "end", seq FROM
    (SELECT *, {DONE.format(n='total')} AS done FROM
      (SELECT user_id, max(upto) AS total, max(seq) + 1 AS seq FROM ({CHUNKS_SQL}) GROUP BY user_id))
    WHERE done * 100 < total"""


def sized_events(spark, folder) -> DataFrame:
    return read(spark, folder, "events").withColumn("n", long(F.floor(F.col("value") * 10)))


@query(f'SELECT event_id, seq, upto - n AS "before", upto FROM ({CHUNKS_SQL})')
def running_offset(spark, folder):
    placed = windows.chunk_offsets(sized_events(spark, folder), ["user_id"], "event_id", "n")
    numbered = running.sequence_numbers(placed, ["user_id"], "event_id")
    return numbered.select("event_id", "seq", "before", "upto")


@query(f'SELECT user_id, seq, win_idx, win_idx * 100 AS start, win_idx * 100 + 500 AS "end" FROM ({WINDOWS_SQL})')
def sliding_windows(spark, folder):
    numbered = running.sequence_numbers(sized_events(spark, folder), ["user_id"], "event_id")
    placed = windows.chunk_offsets(numbered, ["user_id"], "event_id", "n")
    return windows.append_windows(placed, CHUNK, STRIDE).select("user_id", "seq", "win_idx", "start", "end")


@query(f'SELECT user_id, win_idx, start, "end" FROM ({LEFT_SQL})')
def flush_residual(spark, folder):
    return windows.flush_windows(sized_events(spark, folder), ["user_id"], "n", CHUNK, STRIDE)


@query("SELECT event_id, trunc(value * 16000)::BIGINT AS samples FROM events")
def seconds_to_samples(spark, folder):
    return read(spark, folder, "events").select(
        "event_id", arrays.seconds_to_samples(F.col("value"), 16000).alias("samples")
    )


@query(
    """SELECT doc_id, k AS win_idx, k * 480 AS start, least(k * 480 + 480, n_chars) AS "end"
        FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars + 479) // 480)) AS k FROM documents)"""
)
def long_form_chunks(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "n_chars")
    return windows.recording_windows(docs, "n_chars", 480).drop("n_chars")


@query(
    """SELECT doc_id, k AS win_idx, k * 120 AS start, least(k * 120 + 480, n_chars) AS "end"
        FROM (SELECT doc_id, n_chars, unnest(range(0, done + CASE WHEN done * 120 < n_chars THEN 1 ELSE 0 END)) AS k
        FROM (SELECT *, CASE WHEN n_chars < 480 THEN 0 ELSE (n_chars - 480) // 120 + 1 END AS done FROM documents))"""
)
def long_form_overlap(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "n_chars")
    return windows.recording_windows(docs, "n_chars", 480, 120).drop("n_chars")


def array_sum(values: Column) -> Column:
    return F.round(F.aggregate(values.cast("array<double>"), F.lit(0.0), lambda a, v: a + v), 6)


SLICED_SQL = """SELECT {key}, k AS win_idx, len(x)::BIGINT AS n, x[1]::DOUBLE AS first, x[len(x)]::DOUBLE AS last,
    round(list_sum(list_transform(x, lambda v: v::DOUBLE)), 6) AS total FROM (SELECT {key}, k,
      list_slice(x, (k * {s} + 1)::BIGINT, least(k * {s} + {c}, len(x))::BIGINT) AS x FROM (SELECT *,
        unnest(range(0, done + CASE WHEN done * {s} < len(x) THEN 1 ELSE 0 END)) AS k FROM (SELECT *,
          CASE WHEN len(x) < {c} THEN 0 ELSE (len(x) - {c}) // {s} + 1 END AS done FROM ({source}))))"""


def described(df: DataFrame, key: str) -> DataFrame:
    x = F.col("samples")
    return df.select(
        key,
        "win_idx",
        long(F.size(x)).alias("n"),
        F.get(x, F.lit(0)).cast("double").alias("first"),
        F.get(x, F.size(x) - 1).cast("double").alias("last"),
        array_sum(x).alias("total"),
    )


@query(SLICED_SQL.format(key="vec_id", c=16, s=4, source="SELECT vec_id, embedding AS x FROM embeddings"))
def window_samples(spark, folder):
    waves = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return described(windows.slice_recordings(waves, "embedding", 16, 4), "vec_id")


LONG_SQL = "SELECT label, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY label"


def long_recordings(spark, folder) -> DataFrame:
    """Frames of long recordings: all vectors of a label, in order."""
    stored = read(spark, folder, "embeddings").select("label", "vec_id", F.col("embedding").alias("samples"))
    placed = running.running_sum(stored, ["label"], "vec_id", F.size("samples"), "upto", total="n_samples")
    return placed.withColumn("frame_idx", arrays.quotient(F.col("upto"), 64) - 1).drop("upto", "vec_id")


@query(SLICED_SQL.format(key="label", c=400, s=160, source=LONG_SQL))
def window_frames(spark, folder):
    """A table of windows joined with the frames it touches."""
    frames = long_recordings(spark, folder)
    lengths = frames.groupBy("label").agg(F.max("n_samples").alias("n"))
    wanted = windows.recording_windows(lengths, "n", 400, 160).drop("n")
    return described(windows.window_samples(wanted, frames, ["label"], 64), "label")


@query(SLICED_SQL.format(key="label", c=400, s=160, source=LONG_SQL))
def frames_cut(spark, folder):
    """The same windows without a join."""
    return described(windows.cut_frames(long_recordings(spark, folder), ["label"], 64, 400, 160), "label")


@query(
    f"""SELECT label, string_agg(len(w) || ':' || list_sum(list_transform(w, lambda v: floor(v::DOUBLE * 1000)))::BIGINT,
        ' ' ORDER BY k) AS text FROM (SELECT label, k, x[k * 300 + 1 : least(k * 300 + 300, len(x))] AS w FROM
        (SELECT *, unnest(range(0, (len(x) + 299) // 300)) AS k FROM ({LONG_SQL}))) GROUP BY label"""
)
def transcribe_recordings(spark, folder):
    """Long recordings cut, recognised and stitched."""
    return transcribe.transcribe_frames(long_recordings(spark, folder), ["label"], 64, sample_sums, 3.0, RATE)


# --- samples ----------------------------------------------------------------------------------

POINTS_SQL = """SELECT vec_id, u.i AS i, round(u.v, 6) AS v FROM (SELECT vec_id,
    unnest(list_transform({x}, lambda v, i: {{'i': i - 1, 'v': v::DOUBLE}})) AS u FROM {source})"""


def points(df: DataFrame, values: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(values).alias("i", "v")).select(
        "vec_id", long(F.col("i")).alias("i"), F.round(F.col("v").cast("double"), 6).alias("v")
    )


@query(
    POINTS_SQL.format(
        x="list_transform(range(1, 33), lambda j: ((x[j] + x[j + 32]) / 2)::FLOAT)",
        source="(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)",
    )
)
def downmix(spark, folder):
    stereo = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return points(read(spark, folder, "embeddings"), audio.downmix(stereo))


@query(
    POINTS_SQL.format(
        x="""list_transform(range(0, 48), lambda j: (x[floor(j * 64 / 48)::BIGINT + 1] + (j * 64 / 48 - floor(j * 64 / 48))
            * (x[least(floor(j * 64 / 48)::BIGINT + 2, 64)] - x[floor(j * 64 / 48)::BIGINT + 1]))::FLOAT)""",
        source="(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)",
    )
)
def resample_linear(spark, folder):
    vectors = read(spark, folder, "embeddings")
    return points(vectors, audio.resample(F.col("embedding"), 64, 48))


@query(
    POINTS_SQL.format(
        x="list_transform(x, lambda v: (v - mu) / sqrt(list_sum(list_transform(x, lambda w: (w - mu) * (w - mu))) / 64 + 1e-7))",
        source="""(SELECT vec_id, x, list_sum(x) / 64 AS mu FROM
            (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings))""",
    )
)
def zscore(spark, folder):
    vectors = training.featurize(read(spark, folder, "embeddings"), arrays.zscore, "embedding")
    return points(vectors, F.col("input_values"))


@query(
    """SELECT event_id, n AS n_samples, (n * level)::BIGINT AS total, n * 4 AS n_bytes FROM
        (SELECT event_id, floor(value * 10)::BIGINT AS n, length(event_type) AS level FROM events)"""
)
def pcm_payload(spark, folder):
    """Samples packed to bytes and unpacked again."""
    packed = stored_payload(sized_events(spark, folder))
    unpacked = audio.unpack_samples(F.col("payload"))
    return packed.select("event_id", F.length("payload").alias("n_bytes"), unpacked.alias("x")).select(
        "event_id",
        long(F.size("x")).alias("n_samples"),
        long(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"),
        long(F.col("n_bytes")).alias("n_bytes"),
    )


# Header of a mono WAV file with 64 samples of 16 bits at 8 kHz.
WAVE_HEADER = "52494646a400000057415645666d74201000000001000100401f0000803e0000020010006461746180000000"


@query(
    """SELECT vec_id, 8000 AS sampling_rate, 64::BIGINT AS n_samples, round(list_sum(list_transform(embedding,
        lambda v: (floor(v::DOUBLE * 1000) / 32768)::FLOAT::DOUBLE)), 6) AS total FROM embeddings"""
)
def wave_decode(spark, folder):
    """PCM WAV contents, 16 bits, made from the vectors and decoded."""
    hexed = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda v: F.lpad(F.hex(F.floor(v * 1000).bitwiseAND(F.lit(0xFFFF))), 4, "0"),
    )
    little_endian = F.transform(hexed, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))
    content = F.unhex(F.concat(F.lit(WAVE_HEADER), F.array_join(little_endian, "")))
    decoded = read(spark, folder, "embeddings").select("vec_id", audio.decode_audio(content).alias("cell"))
    samples = F.col("cell.array")
    return decoded.select(
        "vec_id",
        F.col("cell.sampling_rate").alias("sampling_rate"),
        long(F.size(samples)).alias("n_samples"),
        array_sum(samples).alias("total"),
    )


def stored_payload(events: DataFrame) -> DataFrame:
    """A chunk of constant level, packed: the level is the length of the event's name."""
    level = F.length("event_type").cast("float")
    return events.withColumn("payload", audio.pack_samples(F.array_repeat(level, F.col("n").cast("int"))))


@query("SELECT doc_id AS seq FROM documents WHERE octet_length(encode(text)) % 4 <> 0")
def broken_chunks(spark, folder):
    chunks = read(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("payload")
    )
    return rolling.broken_chunks(chunks).select("seq")


# --- token ids ------------------------------------------------------------------------------------


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def argmax(spark, folder):
    return read(spark, folder, "embeddings").select("vec_id", long(arrays.argmax(F.col("embedding"))).alias("best"))


COARSE_SQL = "SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 20)::BIGINT % 4) AS ids FROM embeddings"


@query(
    f"""SELECT vec_id, array_to_string(list_filter(ids, lambda x, i: x <> 0 AND (i = 1 OR x <> ids[i - 1])), ' ') AS ids
        FROM ({COARSE_SQL})"""
)
def ctc_greedy(spark, folder):
    coarse = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: (F.floor(F.abs(x) * 20) % 4).cast("int")
    )
    return read(spark, folder, "embeddings").select(
        "vec_id", F.array_join(arrays.ctc_collapse(coarse, 0).cast("array<string>"), " ").alias("ids")
    )


LETTERS = [(0, "<blank>", True), (1, "a", False), (2, "b", False), (3, "c", False)]


def frame_sql(value: str) -> str:
    """Sixteen frames of four scores per vector, decoded to letters."""
    frames = f"list_transform(range(0, 16), lambda f: list_transform(x[f * 4 + 1 : f * 4 + 4], lambda v: {value}))"
    ids = f"list_transform({frames}, lambda s: list_position(s, list_max(s)) - 1)"
    kept = "list_filter(ids, lambda x, i: x <> 0 AND (i = 1 OR x <> ids[i - 1]))"
    letters = f"array_to_string(list_transform({kept}, lambda x: ['a', 'b', 'c'][x]), '')"
    return f"SELECT vec_id, {letters} AS text FROM (SELECT vec_id, {ids} AS ids FROM (SELECT vec_id, embedding AS x FROM embeddings))"


def spoken(spark, folder, change: Callable[[Column], Column]) -> DataFrame:
    vocab = spark.createDataFrame(LETTERS, VOCAB)
    frames = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda f: F.transform(F.slice("embedding", f * 4 + 1, F.lit(4)), change)
    )
    scored = read(spark, folder, "embeddings").select("vec_id", frames.alias("scores"))
    return training.decode_predictions(scored, "scores", vocab).select("vec_id", "text")


@query(frame_sql("v"))
def ctc_text(spark, folder):
    return spoken(spark, folder, lambda v: v)


@query(
    f"""SELECT round(sum(levenshtein(h.text, r.text)) / sum(length(r.text)), 9) AS wer
        FROM ({frame_sql('abs(v)')}) r JOIN ({frame_sql('v')}) h USING (vec_id)"""
)
def ctc_wer(spark, folder):
    """Letters as words: decodings of the scores against decodings of their magnitudes."""

    def spaced(df):
        return df.withColumn("text", F.array_join(F.split("text", ""), " "))

    references, hypotheses = spoken(spark, folder, F.abs), spoken(spark, folder, lambda v: v)
    score = training.evaluate_wer(spaced(references), spaced(hypotheses), ["vec_id"])
    return score.select(F.round("wer", 9).alias("wer"))


CHARS_SQL = """SELECT doc_id, u.i AS i, u.c AS c FROM (SELECT doc_id,
    unnest(list_transform(string_split(text, ''), lambda c, i: {'i': i, 'c': c})) AS u FROM documents)"""
VOCAB_SQL = f"SELECT c, row_number() OVER (ORDER BY c) + 1 AS token_id FROM (SELECT DISTINCT c FROM ({CHARS_SQL}))"
ENCODED_SQL = f"""SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(token_id, ' ' ORDER BY i)) AS ids_md5
    FROM ({CHARS_SQL}) JOIN ({VOCAB_SQL}) USING (c) GROUP BY doc_id"""


def id_digest(df: DataFrame, ids: Column) -> DataFrame:
    return df.select(
        "doc_id", long(F.size(ids)).alias("n"), F.md5(F.array_join(ids.cast("array<string>"), " ")).alias("ids_md5")
    )


def encoded(spark, folder) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    vocab = lexicon.char_vocabulary(docs, "text")
    return lexicon.encode_characters(docs, "text", vocab), vocab


@query(f"SELECT token_id::INTEGER AS token_id, c AS token FROM ({VOCAB_SQL})")
def vocabulary(spark, folder):
    docs = read(spark, folder, "documents")
    return lexicon.char_vocabulary(docs, "text").filter("NOT is_special").select("token_id", "token")


@query(ENCODED_SQL)
def vocab_encode(spark, folder):
    return id_digest(encoded(spark, folder)[0], F.col("labels"))


@query("SELECT doc_id, length(text)::BIGINT AS n, md5(text) AS text_md5 FROM documents")
def vocab_decode(spark, folder):
    ids, vocab = encoded(spark, folder)
    back = lexicon.decode_ids(ids.select("doc_id", "labels"), "labels", vocab)
    return back.select("doc_id", long(F.length("text")).alias("n"), F.md5("text").alias("text_md5"))


@query(ENCODED_SQL)
def vocab_encode_joined(spark, folder):
    """Rows that share a key, here the source, stay rows of their own with all their columns."""
    docs = read(spark, folder, "documents").select("source", "doc_id", "text")
    coded = lexicon.encode_characters(docs, "text", lexicon.char_vocabulary(docs, "text"))
    return id_digest(coded, F.col("labels"))


# --- label batches: word lengths as ids, four documents to a batch --------------------------------------

PADDED_SQL = """SELECT doc_id, len(ids)::BIGINT AS n, (len(list_filter(ids, lambda x: x = -100)))::BIGINT AS masked,
    md5(array_to_string(ids, ' ')) AS ids_md5 FROM ({padded})"""
IDS_SQL = """SELECT doc_id, ids, max(len(ids)) OVER (PARTITION BY doc_id // 4) AS longest FROM
    (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents)"""


def label_batches(spark, folder) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return read(spark, folder, "documents").select(
        "doc_id", arrays.quotient(F.col("doc_id"), 4).alias("batch_id"), ids.alias("labels")
    )


CORPUS_TREE_SQL = r"""SELECT doc_id, doc_id::VARCHAR AS utt_id, source AS speaker_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    trim(regexp_replace(regexp_extract(text, '^[^\n]*'), '\s+', ' ', 'g')) AS line FROM documents"""


def stored_tree(spark, folder) -> str:
    """A studio corpus on disk: a folder per speaker with a (silent) recording per document, and prompts for most of them."""
    root = shared_path(spark, "corpus-tree")
    line = F.trim(F.regexp_replace(F.regexp_extract("text", "^[^\n]*", 0), r"\s+", " "))
    docs = read(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("utt_id"), "source", line.alias("line"), "doc_id",
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    name = F.concat("split", F.lit("/waves/"), "source", F.lit("/"), "utt_id", F.lit(".wav"))
    waves.write_waves(docs.select(name.alias("name"), F.array(F.lit(0.0)).alias("samples")), root, 16000)
    for split in ("train", "test"):
        prompts = docs.filter((F.col("split") == split) & (F.col("doc_id") % 7 != 0))
        prompts.select(F.concat_ws(" ", "utt_id", "line").alias("value")).write.text(f"{root}/{split}/prompts.txt")
    return root


@query(f"SELECT split, speaker_id, utt_id, line AS text FROM ({CORPUS_TREE_SQL}) WHERE doc_id % 7 <> 0 AND line <> ''")
def corpus_manifest(spark, folder):
    """The whole job: recordings listed, joined with their prompts, and written as manifests, which are read back."""
    root, target = stored_tree(spark, folder), shared_path(spark, "corpus-manifest")
    manifest_jobs.build_manifest(spark, root, target)
    splits = {split: f"{target}/split={split}" for split in ("train", "test")}
    records = manifests.read_manifests(spark, splits)
    return records.select("split", "speaker_id", text.path_stem(F.col("audio_filepath")).alias("utt_id"), "text")


@query(f"SELECT split, speaker_id, utt_id FROM ({CORPUS_TREE_SQL}) WHERE doc_id % 7 = 0 OR line = ''")
def corpus_unmatched(spark, folder):
    return manifest_jobs.unmatched_report(spark, stored_tree(spark, folder)).select("split", "speaker_id", "utt_id")


@query(PADDED_SQL.format(padded=f"SELECT doc_id, list_resize(ids, longest, -100) AS ids FROM ({IDS_SQL})"))
def pad_labels_ctc(spark, folder):
    return padded(spark, folder, rows_per_batch=4)


@query(PADDED_SQL.format(padded=f"SELECT doc_id, list_resize(ids, longest, -100) AS ids FROM ({IDS_SQL})"))
def pad_labels_any_batch(spark, folder):
    """The path for batches of unknown size."""
    return padded(spark, folder)


@query(
    PADDED_SQL.format(
        padded=f"""SELECT doc_id, list_transform(list_resize(ids, ((longest + 15) // 16) * 16, -100),
            lambda x: CASE WHEN x = 3 THEN -100 ELSE x END) AS ids FROM ({IDS_SQL})"""
    )
)
def pad_labels_seq2seq(spark, folder):
    return padded(spark, folder, mode="seq2seq", pad_id=3, rows_per_batch=4)


def padded(spark, folder, **options) -> DataFrame:
    return label_digest(labels.pad_labels(label_batches(spark, folder), **options))


def label_digest(df: DataFrame) -> DataFrame:
    ids = F.col("labels")
    return df.select(
        "doc_id",
        long(F.size(ids)).alias("n"),
        long(F.size(F.filter(ids, lambda x: x == arrays.IGNORED_LABEL))).alias("masked"),
        F.md5(F.array_join(ids.cast("array<string>"), " ")).alias("ids_md5"),
    )


@query(
    """SELECT vec_id, len(x)::BIGINT AS input_length, len(x) // 8 AS frames, (vec_id % 9)::BIGINT AS label_length, TRUE AS full_batch,
        TRUE AS padded_together, md5(array_to_string(list_transform(x, lambda v: floor(v::DOUBLE * 1000)::BIGINT), ' ')) AS values_md5
    FROM (SELECT vec_id, embedding[1:1 + (vec_id * 7) % 64] AS x FROM embeddings)"""
)
def padded_batches(spark, folder):
    """Features of one and of two dimensions, and labels, padded in the task. Which rows share a batch is left open; sizes, lengths
    and masks must agree within each."""
    x = F.slice("embedding", F.lit(1), (1 + (F.col("vec_id") * 7) % 64).cast("int"))
    frames = F.transform(F.sequence(F.lit(0), arrays.quotient(F.size("x"), 8).cast("int") - 1), lambda i: F.slice("x", i * 8 + 1, F.lit(8)))
    none = F.array().cast("array<array<float>>")
    table = read(spark, folder, "embeddings").select("vec_id", x.alias("x")).select(
        "vec_id", "x", F.when(F.size("x") >= 8, frames).otherwise(none).alias("frames"),
        F.array_repeat(F.lit(5), (F.col("vec_id") % 9).cast("int")).alias("labels"),
    )
    one = batches.form_batches(table.drop("frames"), 4, features="x", pad_id=0)
    two = batches.form_batches(table.drop("x"), 4, features="frames", mode="seq2seq", pad_id=0)
    # A batch is whole if its rows have the size of the longest, and only the padding is masked.
    masked = F.size(F.filter("labels", lambda v: v == arrays.IGNORED_LABEL)) == F.size("labels") - F.col("label_length")
    tail = lambda c: F.slice(c, F.col("input_length") + 1, F.greatest(F.size(c) - F.col("input_length"), F.lit(0)))
    blank = F.forall(tail("x"), lambda v: v == 0) & masked
    blank_frames = F.forall(tail("frames"), lambda f: (F.size(f) == 8) & F.forall(f, lambda v: v == 0)) & masked

    def told(df, column, ok, target):
        same = Window.partitionBy("batch_id")
        size, longest = F.size(column), F.max("input_length").over(same)
        labels_of = F.size("labels") == target(F.max("label_length").over(same))
        return df.select(
            "*", ((F.count(F.lit(1)).over(same) <= 4) & (F.min(size).over(same) == longest)).alias("full"), (ok & labels_of).alias("together")
        )

    first = told(one, "x", blank, lambda n: n)
    second = told(two, "frames", blank_frames, lambda n: F.ceil(n / 16) * 16).select(
        "vec_id", F.col("input_length").alias("n_frames"), F.col("full").alias("full_2"), F.col("together").alias("together_2")
    )
    real = F.transform(F.slice("x", F.lit(1), F.col("input_length")), lambda v: F.floor(v.cast("double") * 1000).cast("string"))
    return first.join(second, "vec_id").select(
        "vec_id", long(F.col("input_length")).alias("input_length"), long(F.col("n_frames")).alias("frames"), long(F.col("label_length")).alias("label_length"),
        (F.col("full") & F.col("full_2")).alias("full_batch"), (F.col("together") & F.col("together_2")).alias("padded_together"),
        F.md5(F.array_join(real, " ")).alias("values_md5"),
    )


@query(PADDED_SQL.format(padded=f"SELECT doc_id, list_resize(ids, longest, 0) AS ids FROM ({IDS_SQL})"))
def unmask(spark, folder):
    out = labels.pad_labels(label_batches(spark, folder), rows_per_batch=4)
    return label_digest(out.withColumn("labels", arrays.unmask_labels(F.col("labels"), 0)))


@query(
    f"""SELECT audio, count(*)::BIGINT AS n, md5(string_agg(token_id, ' ' ORDER BY i)) AS ids_md5 FROM (SELECT audio, u.i AS i, u.c AS c
        FROM (SELECT audio, unnest(list_transform(string_split(transcript, ''), lambda c, i: {{'i': i, 'c': c}})) AS u
        FROM (SELECT audio, {norm_sql('sentence')} AS transcript FROM ({CORPUS_SQL}) WHERE split IN ('train', 'validation'))))
        JOIN (SELECT c, row_number() OVER (ORDER BY c) + 1 AS token_id FROM (SELECT DISTINCT unnest(string_split(
          {norm_sql('sentence')}, '')) AS c FROM ({CORPUS_SQL}))) USING (c) GROUP BY audio"""
)
def training_table(spark, folder):
    """Training and evaluation labels; which rows share a batch is left open, so only
    the labels that are not padding are compared."""
    prepared = shared_path(spark, "prepared")
    tables.write_processed(columns.prune_columns(columns.map_transcript(corpus(spark, folder))), prepared)
    ready = corpora.read_processed(spark, prepared)
    vocab = lexicon.char_vocabulary(ready, "transcript")
    train, evaluation = training.build_training_table(ready, vocab)
    both = train.unionByName(evaluation)
    real = F.filter("labels", lambda x: x != arrays.IGNORED_LABEL)
    return both.select("audio", real.alias("ids")).select(
        "audio", long(F.size("ids")).alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_md5")
    )


# --- recognition with a stand-in recogniser ---------------------------------------------------------------


def sample_sums():
    """Stand-in recogniser: number of samples and their sum in thousandths."""

    @hears_batches(64, 1 << 20)
    def recognise(windows, rate):
        lengths = [len(samples) for samples in windows]
        values = np.floor(np.concatenate(windows).astype(np.float64) * 1000)
        if min(lengths) == max(lengths):
            totals = values.reshape(len(windows), lengths[0]).sum(axis=1).tolist()
        else:  # whole numbers, so differences of running sums are exact
            upto, sums = np.cumsum([0, *lengths]), np.concatenate(([0.0], np.cumsum(values)))
            totals = (sums[upto[1:]] - sums[upto[:-1]]).tolist()
        return [{"text": f" {n}:{int(total)} "} for n, total in zip(lengths, totals, strict=True)]

    return recognise


@query(
    """SELECT vec_id, k AS win_idx, '16:' || list_sum(list_transform(embedding[k * 8 + 1 : k * 8 + 16],
        lambda v: floor(v::DOUBLE * 1000)))::BIGINT AS text
        FROM (SELECT vec_id, embedding, unnest(range(0, 7)) AS k FROM embeddings)
        UNION ALL SELECT vec_id, 7, '8:' || list_sum(list_transform(embedding[57 : 64],
        lambda v: floor(v::DOUBLE * 1000)))::BIGINT FROM embeddings"""
)
def transcribe_slices(spark, folder):
    recordings = read(spark, folder, "embeddings").select("vec_id", "embedding")
    cut = windows.slice_recordings(recordings, "embedding", 16, 8)
    return transcribe_windows(cut, sample_sums, RATE).select("vec_id", "win_idx", "text")


@query(
    """SELECT vec_id, '64:' || list_sum(list_transform(embedding, lambda v: floor(v::DOUBLE * 1000)))::BIGINT AS text
        FROM embeddings"""
)
def transcribe_waveforms(spark, folder):
    recordings = read(spark, folder, "embeddings").select(
        "vec_id", F.lit(RATE).alias("sampling_rate"), F.col("embedding").alias("array")
    )
    return transcribe.transcribe_waveforms(recordings, sample_sums, RATE).select("vec_id", "text")


@query(
    """SELECT vec_id, string_agg(n || ':' || total, ' ' ORDER BY k) AS text, count(*)::BIGINT AS chunks FROM (
        SELECT vec_id, k, len(part) AS n, list_sum(list_transform(part, lambda v: floor(v / 32768 * 1000)))::BIGINT AS total FROM (
        SELECT vec_id, k, list_transform(embedding[k * 20 + 1 : k * 20 + 20],
            lambda v: least(greatest(floor(v::DOUBLE * 32768), -32768), 32767)) AS part
        FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS k FROM embeddings))) GROUP BY vec_id"""
)
def transcribe_wave_files(spark, folder):
    """Vectors as WAV files, which are listed, read in ranges, recognised and stitched."""
    root = shared_path(spark, "waves")
    name = F.concat((F.col("vec_id") % 10).cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".wav"))
    waves.write_waves(read(spark, folder, "embeddings").select(name.alias("name"), F.col("embedding").alias("samples")), root, RATE)
    found = transcribe.transcribe_files(spark, root, sample_sums, 20 / RATE, RATE)
    return found.select(long(text.path_stem(F.col("path"))).alias("vec_id"), "text", long(F.size("chunks")).alias("chunks"))


HEARD_SQL = f"""WITH c AS MATERIALIZED (SELECT *, upto - n AS at FROM ({CHUNKS_SQL})),
    w AS (SELECT user_id, seq, win_idx, win_idx * 100 AS a, win_idx * 100 + 500 AS b, 'partial' AS type FROM ({WINDOWS_SQL})
      UNION ALL SELECT user_id, seq, win_idx, start, "end", 'final' FROM ({LEFT_SQL})),
    t AS (SELECT w.user_id, w.seq, w.win_idx, w.type, (b - a) || ':' ||
      sum(c.level * 1000 * (least(c.upto, b) - greatest(c.at, a)))::BIGINT AS text
      FROM w JOIN c ON c.user_id = w.user_id AND c.upto > a AND c.at < b GROUP BY w.user_id, w.seq, w.win_idx, w.type, a, b)
    SELECT user_id::VARCHAR AS session, seq, type, string_agg(text, ' ' ORDER BY win_idx) AS text FROM t
    GROUP BY user_id, seq, type"""


def chunk_table(spark, folder) -> DataFrame:
    """Events as chunk rows with contiguous numbers and a closing row per session."""
    numbered = running.sequence_numbers(sized_events(spark, folder), ["user_id"], "event_id")
    session = F.col("user_id").cast("string").alias("session")
    sent = stored_payload(numbered).select(
        session, "seq", F.col("ts").cast("timestamp").alias("ts"), "payload", F.lit(False).alias("eos")
    )
    closing = read(spark, folder, "events").groupBy(session).agg(
        F.count("*").alias("seq"), F.max("ts").cast("timestamp").alias("ts")
    )
    closing = closing.select("session", "seq", "ts", F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("eos"))
    return sent.unionByName(closing)


def live_messages(spark, folder) -> DataFrame:
    """Chunks are stored, streamed through the rolling buffer and read back as messages."""
    base = shared_path(spark, "stream")
    chunk_table(spark, folder).write.parquet(f"{base}/chunks")
    messages = rolling.stream_transcribe(
        stream.read_pcm_stream(spark, f"{base}/chunks"), sample_sums, RATE, CHUNK / RATE, STRIDE / RATE
    )
    tables.write_messages(messages, f"{base}/messages", f"{base}/state", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/messages")


@query(f"SELECT * FROM ({HEARD_SQL}) WHERE type = 'partial'")
def stream_partials(spark, folder):
    return live_messages(spark, folder).filter("type = 'partial'")


@query(f"SELECT * FROM ({HEARD_SQL}) WHERE type = 'final'")
def stream_finals(spark, folder):
    return live_messages(spark, folder).filter("type = 'final'")


@query(HEARD_SQL)
def replayed_sessions(spark, folder):
    """The same messages from stored chunks, without a stream."""
    path = shared_path(spark, "chunks")
    windows.count_samples(chunk_table(spark, folder)).write.parquet(path)
    stored = spark.read.schema(f"{CHUNK_SCHEMA.toDDL()}, n_samples bigint").parquet(path)
    return transcribe.replay_sessions(stored, sample_sums, RATE, CHUNK / RATE, STRIDE / RATE)


@query(HEARD_SQL)
def replayed_with_duplicates(spark, folder):
    """The same again from rows that were sent twice, and with rows that came after their session's end."""
    path = shared_path(spark, "chunks")
    chunks = chunk_table(spark, folder)
    chunks.write.parquet(path)
    stored = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    repeats = stored.filter(F.xxhash64("session", "seq") % 3 == 0)
    late = stored.filter("seq % 5 = 0 AND NOT eos").withColumn("seq", F.col("seq") + 1_000_000)
    everything = stored.unionByName(repeats).unionByName(late).unionByName(stored.filter("eos"))
    return transcribe.replay_sessions(everything, sample_sums, RATE, CHUNK / RATE, STRIDE / RATE)


@query(
    f"""SELECT audio, {norm_sql('sentence')} AS text FROM ({CORPUS_SQL}) WHERE split IN ('train', 'validation')"""
)
def decoded_labels(spark, folder):
    """Padded label batches back to text."""
    ready = columns.prune_columns(columns.map_transcript(corpus(spark, folder)))
    vocab = lexicon.char_vocabulary(ready, "transcript")
    train, evaluation = training.build_training_table(ready, vocab)
    decoded = training.decode_labels(train.unionByName(evaluation), "labels", vocab, pad_id=0)
    return decoded.select("audio", "text")


@query(f"SELECT label, total AS text FROM (SELECT label, len(x) || ':' || list_sum(list_transform(x, lambda v: floor(v::DOUBLE * 1000)))::BIGINT AS total FROM ({LONG_SQL}))")
def transcribe_whole_frames(spark, folder):
    """Recordings stored as frames, each heard as one window."""
    return transcribe.transcribe_frames(long_recordings(spark, folder), ["label"], 64, sample_sums, 0, RATE)
