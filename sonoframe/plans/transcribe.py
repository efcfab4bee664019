"""Jobs that turn audio into text."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoframe.functions.audio import Resampler, convert_payload, linear_resampler, payload_is_whole, resample
from sonoframe.functions.recognise import RecogniserFactory, spread, transcribe_spans, transcribe_windows
from sonoframe.functions.text import segment_label, strip
from sonoframe.operators.concat import concat_segments
from sonoframe.operators.windows import cut_frames, replayed_spans, window_sizes
from sonoframe.sources.audio import read_audio_windows


def transcribe_files(
    spark: SparkSession,
    paths: str | list[str],
    factory: RecogniserFactory,
    chunk_length_s: float = 30.0,
    sampling_rate: int = 16000,
    metadata: dict[str, str] | None = None,
    resampler: Resampler = linear_resampler,
    spread_work: bool = True,
) -> DataFrame:
    """Recordings to ``(path, text, chunks, metadata)``.

    Recordings of any size are read in ranges, which tasks all over the cluster read, cut and recognise; samples are not
    shuffled. ``spread_work`` deals out the windows of files that have to be read as a whole (see ``read_audio_windows``).
    """
    windows = read_audio_windows(spark, paths, chunk_length_s, target_sr=sampling_rate, resampler=resampler)
    if spread_work and resampler is not linear_resampler:
        windows = spread(windows, "path", "win_idx")
    heard = transcribe_windows(windows, factory, sampling_rate)
    piece = F.struct(
        "win_idx",
        (F.col("start") / F.lit(sampling_rate)).alias("start"),
        (F.col("end") / F.lit(sampling_rate)).alias("end"),
        "text",
    )
    stitched = heard.groupBy("path").agg(F.sort_array(F.collect_list(piece)).alias("chunks"))
    pairs = [F.lit(x) for pair in (metadata or {}).items() for x in pair]
    return stitched.select(
        "path",
        F.array_join(F.transform("chunks", lambda c: strip(c["text"])), " ").alias("text"),
        F.transform("chunks", lambda c: F.struct(c["start"], c["end"], c["text"])).alias("chunks"),
        F.create_map(*pairs).cast("map<string,string>").alias("metadata"),
    )


def transcribe_frames(
    frames: DataFrame,
    keys: list[str],
    frame: int,
    factory: RecogniserFactory,
    chunk_length_s: float = 30.0,
    sampling_rate: int = 16000,
) -> DataFrame:
    """Recordings of any length, stored as frames (``frame_idx, n_samples, samples``), to
    ``(keys, text)``. No row and no group holds more than one window of samples."""
    # A window of 0 seconds is the whole recording, of whatever length.
    chunk = window_sizes(chunk_length_s, chunk_length_s, sampling_rate)[0] if chunk_length_s else 0
    heard = transcribe_windows(cut_frames(frames, keys, frame, chunk), factory, sampling_rate)
    return concat_segments(heard, keys, "win_idx", mode="strip_each")


def segment_lines(transcripts: DataFrame) -> DataFrame:
    """One printable line per chunk: ``(path, pos, line)``."""
    chunks = transcripts.select("path", F.posexplode("chunks").alias("pos", "c"))
    return chunks.select("path", "pos", segment_label(F.col("c.start"), F.col("c.end"), F.col("c.text")).alias("line"))


def transcribe_waveforms(
    df: DataFrame,
    factory: RecogniserFactory,
    sampling_rate: int = 16000,
    samples: str = "array",
    rate: str = "sampling_rate",
    resampler: Resampler = linear_resampler,
) -> DataFrame:
    """Whole waveforms held in rows to text, resampled first where the rate differs."""
    at_rate = df.withColumn(samples, resample(F.col(samples), F.col(rate), sampling_rate, resampler))
    return transcribe_windows(at_rate.withColumn(rate, F.lit(sampling_rate)), factory, sampling_rate, samples)


def replay_sessions(
    chunks: DataFrame,
    factory: RecogniserFactory,
    sampling_rate: int = 16000,
    chunk_s: float = 5.0,
    stride_s: float = 1.0,
    source_rate: int | None = None,
    channels: int = 1,
    resampler: Resampler = linear_resampler,
) -> DataFrame:
    """Messages of finished sessions, computed from stored chunks in one batch job.

    The same messages as the live stream sends, without its state: repeated rows, rows after the end of
    a session and rows beyond a missing number count as little as there. A session is cut
    into spans that are worked on in parallel.
    """
    chunk, stride = window_sizes(chunk_s, stride_s, sampling_rate)
    payload = convert_payload(F.col("payload"), source_rate or sampling_rate, sampling_rate, channels, resampler)
    whole = F.when(payload_is_whole(payload), payload)
    rows = chunks.withColumn("payload", whole)
    if source_rate not in (None, sampling_rate) or channels > 1:
        rows = rows.drop("n_samples")  # it counted other samples
    heard = transcribe_spans(replayed_spans(rows, chunk, stride), factory, sampling_rate, chunk, stride)
    # The windows that one chunk completes may lie in several spans.
    return concat_segments(heard, ["session", "seq", "type"], "win_idx")
