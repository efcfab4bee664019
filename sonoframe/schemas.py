"""Declared schemas; nothing in the package infers one from data."""

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("audio_filepath", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("speaker_id", T.StringType()),
    ]
)

# ``audio`` holds the path of the recording; samples are only read on request.
UTTERANCE = T.StructType(
    [
        T.StructField("audio", T.StringType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

CROWD_UTTERANCE = T.StructType(
    [
        T.StructField("audio", T.StringType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("up_votes", T.IntegerType()),
        T.StructField("down_votes", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

AUDIO = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sampling_rate", T.IntegerType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("array", T.ArrayType(T.FloatType(), False)),
    ]
)

# One row per message of a live connection. ``seq`` runs 0, 1, 2, ... inside a
# session and the closing ``eos`` row takes the next number.
CHUNK = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("eos", T.BooleanType()),
    ]
)

# A run of overlapping windows stored once: window ``first_win + i`` covers the
# ``chunk`` samples that start ``i * stride`` into ``span``. A ``final`` row is a
# single window that covers the whole span.
SPAN = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("first_win", T.LongType()),
        T.StructField("n_win", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("span", T.BinaryType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

VOCAB = T.StructType(
    [
        T.StructField("token_id", T.IntegerType()),
        T.StructField("token", T.StringType()),
        T.StructField("is_special", T.BooleanType()),
    ]
)
