"""Overlapping windows over recordings and over streams of chunks.

With ``N`` samples seen, windows of ``chunk`` samples every ``stride`` samples:
``windows_done(N)`` of them are complete, window ``k`` covers
``[k*stride, k*stride + chunk)``, and ``[windows_done(N)*stride, N)`` is left over.
All of it is arithmetic on offsets; samples are joined in at the end.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sonoframe.functions.arrays import quotient
from sonoframe.functions.audio import payload_is_whole
from sonoframe.operators.joins import lookup_join
from sonoframe.operators.running import running_sum, sequence_numbers
from sonoframe.shared import shared_path

FINAL = -1  # block number of a session's last span


def window_sizes(chunk_s: float, stride_s: float, sampling_rate: int) -> tuple[int, int]:
    """Window and hop in samples. Both must hold at least one sample."""
    if chunk_s <= 0:
        raise ValueError("the window length must be positive")
    if stride_s <= 0:
        raise ValueError("the hop must be positive")
    if stride_s > chunk_s:
        raise ValueError("the hop must not exceed the window length")
    chunk, stride = int(chunk_s * sampling_rate), int(stride_s * sampling_rate)
    if min(chunk, stride) < 1:
        raise ValueError("window and hop must each be at least one sample long")
    return chunk, stride


def windows_done(n_samples: Column, chunk: int, stride: int) -> Column:
    return F.when(n_samples < chunk, F.lit(0).cast("bigint")).otherwise(quotient(n_samples - chunk, stride) + 1)


def chunk_offsets(
    chunks: DataFrame, keys: list[str], order: str, n_samples: str, **per_key
) -> DataFrame:
    """Add the sample offsets ``before`` and ``upto`` of every chunk in its session."""
    summed = running_sum(chunks, keys, order, F.col(n_samples), "upto", **per_key)
    return summed.withColumn("before", F.col("upto") - F.col(n_samples).cast("bigint"))


def append_windows(offsets: DataFrame, chunk: int, stride: int) -> DataFrame:
    """The windows each chunk completes: adds ``win_idx``, ``start``, ``end``."""
    first = windows_done(F.col("before"), chunk, stride)
    last = windows_done(F.col("upto"), chunk, stride) - 1
    completing = offsets.withColumn("_first", first).withColumn("_last", last).filter(F.col("_last") >= F.col("_first"))
    return (
        completing.withColumn("win_idx", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
        .withColumn("start", F.col("win_idx") * stride)
        .withColumn("end", F.col("start") + chunk)
    )


def flush_windows(chunks: DataFrame, keys: list[str], n_samples: str, chunk: int, stride: int) -> DataFrame:
    """What is left at the end of each session: ``win_idx, start, end``, none if nothing is.

    The leftover of a session with complete windows starts inside the last of them.
    """
    totals = chunks.groupBy(*keys).agg(F.sum(F.col(n_samples).cast("bigint")).alias("end"))
    left = totals.withColumn("win_idx", windows_done(F.col("end"), chunk, stride)).withColumn(
        "start", F.col("win_idx") * stride
    )
    return left.filter(F.col("start") < F.col("end")).select(*keys, "win_idx", "start", "end")


def recording_windows(df: DataFrame, n_samples: str, chunk: int, stride: int | None = None) -> DataFrame:
    """Cut each row's recording into windows plus the remaining piece.

    Adds ``win_idx, start, end``. ``stride`` is the window length unless windows
    are to overlap; ``chunk`` 0 leaves every recording whole.
    """
    n = F.col(n_samples).cast("bigint")
    if not chunk:
        whole = df.filter(n > 0).withColumn("win_idx", F.lit(0).cast("bigint"))
        return whole.withColumn("start", F.lit(0).cast("bigint")).withColumn("end", n)
    stride = stride or chunk
    done = windows_done(n, chunk, stride)
    # One piece more when samples are left behind the last complete window.
    last = F.when(done * stride < n, done).otherwise(done - 1)
    return (
        df.withColumn("_last", last)
        .filter(F.col("_last") >= 0)
        .withColumn("win_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
        .drop("_last")
        .withColumn("start", F.col("win_idx") * stride)
        .withColumn("end", F.least(F.col("start") + chunk, n))
    )


def slice_recordings(df: DataFrame, samples: str, chunk: int, stride: int | None = None) -> DataFrame:
    """Windows of recordings that fit in a row, cut from the row's own array, no join.

    Replaces ``samples`` by one row per window with ``win_idx, start, end, samples``.
    """
    bare = [c for c in df.columns if c != samples]
    size = F.size(samples).cast("bigint")
    if not chunk:
        chunk_of, stride_of, done = size, size, F.lit(1).cast("bigint")
    else:
        stride = stride or chunk
        chunk_of, stride_of, done = F.lit(chunk), F.lit(stride), windows_done(size, chunk, stride)
    last = F.when(done * stride_of < size, done).otherwise(done - 1)

    def piece(k: Column) -> Column:
        start = k * stride_of
        end = F.least(start + chunk_of, size)
        return F.struct(
            k.alias("win_idx"),
            start.cast("bigint").alias("start"),
            end.cast("bigint").alias("end"),
            F.slice(samples, (start + 1).cast("int"), (end - start).cast("int")).alias("samples"),
        )

    pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), last), piece)
    return df.filter((size > 0) & (last >= 0)).select(*bare, F.inline(pieces))


def to_frames(df: DataFrame, samples: str, frame: int) -> DataFrame:
    """Recordings as frames of ``frame`` samples: ``frame_idx``, ``samples`` and the
    recording's ``n_samples`` in place of the array."""
    bare = [c for c in df.columns if c != samples]
    pieces = F.transform(
        F.sequence(F.lit(0).cast("bigint"), quotient(F.size(samples) - 1, frame)),
        lambda i: F.struct(
            i.alias("frame_idx"),
            F.size(samples).cast("bigint").alias("n_samples"),
            F.slice(samples, (i * frame + 1).cast("int"), F.lit(frame)).alias("samples"),
        ),
    )
    return df.filter(F.size(samples) > 0).select(*bare, F.inline(pieces))


def cut_frames(frames: DataFrame, keys: list[str], frame: int, chunk: int, stride: int | None = None) -> DataFrame:
    """Windows of long recordings from frames that carry ``n_samples``, in one shuffle.

    A frame computes the windows it lies in and sends each of them the part it
    needs, so there is no table of windows and no join. Windows are those of
    ``recording_windows``: ``win_idx, start, end, samples``. ``chunk`` 0 puts every recording together whole, in one value.
    """
    if not chunk:
        parts = F.sort_array(F.collect_list(F.struct("frame_idx", "samples")))
        whole = frames.groupBy(*keys).agg(F.max("n_samples").alias("end"), parts.alias("_parts"))
        zero = F.lit(0).cast("bigint")
        joined = F.flatten(F.transform("_parts", lambda p: p["samples"]))
        return whole.select(*keys, zero.alias("win_idx"), zero.alias("start"), F.col("end").cast("bigint").alias("end"), joined.alias("samples"))
    stride = stride or chunk
    n = F.col("n_samples")
    begin = F.col("frame_idx").cast("bigint") * frame
    placed = frames.withColumn("_from", begin).withColumn("_to", F.least(begin + frame, n)).withColumn(
        "_done", windows_done(n, chunk, stride)
    )
    # Complete windows k with k*stride < _to and k*stride + chunk > _from.
    first = F.greatest(F.lit(0).cast("bigint"), quotient(F.greatest(F.col("_from") - chunk, F.lit(-stride)) + stride, stride))
    last = F.least(quotient(F.col("_to") - 1, stride), F.col("_done") - 1)
    none = F.array().cast("array<bigint>")
    complete = F.when(last >= first, F.sequence(first, last)).otherwise(none)
    rest = F.when(F.col("_to") > F.col("_done") * stride, F.array(F.col("_done"))).otherwise(none)
    reached = placed.withColumn("win_idx", F.explode(F.concat(complete, rest)))
    start = F.col("win_idx") * stride
    cut = reached.withColumn("start", start).withColumn("end", F.least(start + chunk, n))
    low, high = F.greatest("_from", "start"), F.least("_to", "end")
    part = F.slice("samples", (low - F.col("_from") + 1).cast("int"), (high - low).cast("int"))
    parts = cut.filter(high > low).select(*keys, "win_idx", "start", "end", low.alias("at"), part.alias("part"))
    gathered = parts.groupBy(*keys, "win_idx", "start", "end").agg(
        F.sort_array(F.collect_list(F.struct("at", "part"))).alias("_parts")
    )
    return gathered.select(
        *keys, "win_idx", "start", "end", F.flatten(F.transform("_parts", lambda p: p["part"])).alias("samples")
    )


def window_samples(windows: DataFrame, frames: DataFrame, keys: list[str], frame: int) -> DataFrame:
    """Samples of any table of windows (``win_idx, start, end``) from a frame table.

    A window names the frames it touches, so this is a hash join on
    ``(keys, frame_idx)`` and never a range join. No group is larger than one
    window, and a long recording spreads over as many groups as it has windows.
    """
    first = quotient(F.col("start"), frame)
    touched = windows.select(
        *keys,
        "win_idx",
        "start",
        "end",
        F.explode(F.sequence(first, quotient(F.col("end") - 1, frame))).alias("frame_idx"),
    )
    stored = frames.select(*keys, F.col("frame_idx").cast("bigint").alias("frame_idx"), "samples")
    parts = touched.join(stored, [*keys, "frame_idx"])
    ordered = F.sort_array(F.collect_list(F.struct("frame_idx", "samples")))
    gathered = parts.groupBy(*keys, "win_idx", "start", "end").agg(ordered.alias("_parts"))
    joined = F.flatten(F.transform("_parts", lambda p: p["samples"]))
    begin = (F.col("start") - first * frame + 1).cast("int")
    length = (F.col("end") - F.col("start")).cast("int")
    return gathered.select(*keys, "win_idx", "start", "end", F.slice(joined, begin, length).alias("samples"))


def count_samples(chunks: DataFrame) -> DataFrame:
    """Add ``n_samples``: the samples in each payload, none if it is broken or missing."""
    whole = F.when(payload_is_whole(F.col("payload")), quotient(F.length("payload"), 4))
    return chunks.withColumn("n_samples", F.coalesce(whole, F.lit(0).cast("bigint")))


def heard_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks a live stream would take: one of each number, up to the first that closes the
    session and not beyond the first number that is missing: ``(_session, seq, n, eos)``, numbers only.

    ``chunks`` has ``session, seq, eos, n``. Of repeats the shortest counts. Numbers are stored in the shared folder, so a payload is not
    looked at again for them.
    """
    eos = F.coalesce("eos", F.lit(False)).alias("eos")
    told = chunks.select(F.struct("session").alias("_session"), "seq", F.struct("n", eos).alias("_copy"))
    once = told.groupBy("_session", "seq").agg(F.min("_copy").alias("_copy")).select("_session", "seq", "_copy.n", "_copy.eos")
    path = shared_path(chunks.sparkSession, "heard-chunks")
    once.write.parquet(path)
    once = chunks.sparkSession.read.schema(once.schema).parquet(path)
    numbered = sequence_numbers(once.select("_session", "seq", "eos"), ["_session"], "seq", "_n")
    ends = numbered.groupBy("_session").agg(
        F.min(F.when(F.col("eos"), F.col("seq"))).alias("_last"), F.min(F.when(F.col("seq") != F.col("_n"), F.col("seq"))).alias("_gap")
    )
    placed = lookup_join(once, ends, ["_session"])
    in_time = (F.col("seq") <= F.coalesce("_last", "seq")) & (F.col("_gap").isNull() | (F.col("seq") < F.col("_gap")))
    return placed.filter(in_time).select("_session", "seq", "n", "eos")


def replayed_spans(chunks: DataFrame, chunk: int, stride: int, windows_per_span: int = 64) -> DataFrame:
    """Spans of stored sessions as the live stream would have heard them, repeats, late rows and gaps included.

    All is decided on numbers. A payload is then moved to its offsets (or, if they are few, they to it), and once more to its span.
    """
    counted = chunks if "n_samples" in chunks.columns else count_samples(chunks)
    rows = counted.select("session", "seq", "payload", "eos", F.col("n_samples").alias("n"))
    offsets = chunk_offsets(
        heard_chunks(rows), ["_session"], "seq", "n", total="total",
        key_max={"last_seq": F.col("seq"), "closed": F.col("eos")},
    )
    offsets = offsets.filter("n > 0").select("_session", F.col("seq").alias("_seq"), F.col("n").alias("_n"), "before", "upto", "total", "last_seq", "closed")
    keyed = rows.filter("n > 0").withColumn("_session", F.struct("session"))
    same = (keyed["_session"] == offsets["_session"]) & (keyed["seq"] == offsets["_seq"]) & (keyed["n"] == offsets["_n"])
    placed = keyed.join(offsets, same).select("session", "seq", "payload", "n", "before", "upto", "total", "last_seq", "closed")
    return _gathered_spans(placed, chunk, stride, windows_per_span)


def chunk_spans(
    chunks: DataFrame, chunk: int, stride: int, windows_per_span: int = 64, block: int = 1024
) -> DataFrame:
    """Stored chunks of whole sessions as spans, the batch form of the live stream.

    ``chunks`` has ``session, seq, payload, eos`` (packed float32, NULL for none).
    Window runs of ``windows_per_span`` become one span each, so samples are
    shuffled about once and not once per overlapping window; what is left of a
    closed session is its ``final`` span. Sessions are cut everywhere, so a long one
    is spread over many tasks. ``seqs`` and ``ends`` list the chunks in a span and
    the offsets at which they end: they tell which chunk completes a window. Chunks
    stored with ``n_samples`` spare the offsets a second read of the payload.
    """
    counted = chunks if "n_samples" in chunks.columns else count_samples(chunks)
    sized = counted.select("session", "seq", "payload", "eos", F.col("n_samples").alias("n"))
    offsets = chunk_offsets(
        sized, ["session"], "seq", "n", total="total", block=block,  # small: rows carry samples
        key_max={"last_seq": F.col("seq"), "closed": F.coalesce("eos", F.lit(False))},
    )
    return _gathered_spans(offsets.filter("n > 0"), chunk, stride, windows_per_span)


def _gathered_spans(offsets: DataFrame, chunk: int, stride: int, windows_per_span: int) -> DataFrame:
    """Spans of chunks that know their offsets and the whole of their session. A repeated chunk counts once."""
    placed = offsets.withColumn("done", windows_done(F.col("total"), chunk, stride))
    hop = stride * windows_per_span
    # Partial spans that [before, upto) reaches into: the last one starts before
    # ``upto``, the first one has windows that end after ``before``.
    last_span = F.least(quotient(F.col("upto") - 1, hop), quotient(F.col("done") - 1, windows_per_span))
    reach = hop - stride + chunk
    first_span = F.greatest(F.lit(0), quotient(F.greatest(F.col("before") - reach, F.lit(-1)) + hop, hop))
    none = F.array().cast("array<bigint>")
    partial_spans = F.when(
        (F.col("done") > 0) & (last_span >= first_span), F.sequence(first_span, last_span)
    ).otherwise(none)
    is_left = F.col("closed") & (F.col("upto") > F.col("done") * stride)
    final_span = F.when(is_left, F.array(F.lit(FINAL).cast("bigint"))).otherwise(none)
    reached = placed.withColumn("block", F.explode(F.concat(partial_spans, final_span)))
    final = F.col("block") == FINAL
    first_win = F.when(final, F.col("done")).otherwise(F.col("block") * windows_per_span)
    n_win = F.when(final, F.lit(1)).otherwise(F.least(F.lit(windows_per_span), F.col("done") - F.col("first_win")))
    partial_end = F.col("start") + (F.col("n_win") - 1) * stride + chunk
    touching = (
        reached.withColumn("kind", F.when(final, "final").otherwise("partial"))
        .withColumn("first_win", first_win)
        .withColumn("n_win", n_win.cast("bigint"))
        .withColumn("start", F.col("first_win") * stride)
        .withColumn("end", F.when(final, F.col("total")).otherwise(partial_end))
        .filter("before < end AND upto > start")
    )
    lo = F.greatest("before", "start")
    hi = F.least("upto", "end")
    pieces = touching.withColumn("_at", lo).withColumn(
        "_piece",
        F.substring(
            F.col("payload"), ((lo - F.col("before")) * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")
        ),
    )
    # A final span is sent by the row that closes the session.
    sender = F.when(F.col("kind") == "final", F.col("last_seq")).otherwise(F.col("seq"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "upto", "seq", "_piece")))
    spans = pieces.withColumn("seq", sender).groupBy("session", "kind", "first_win", "n_win", "start", "end").agg(
        ordered.alias("_pieces")
    )
    # Chunks have samples, so none but a repeat begins where another one does.
    once = F.filter("_pieces", lambda x, i: (i == 0) | (F.get("_pieces", i - 1)["_at"] != x["_at"]))
    return spans.withColumn("_pieces", once).select(
        "session",
        "kind",
        "first_win",
        "n_win",
        "start",
        "end",
        F.col("_pieces.seq").alias("seqs"),
        F.col("_pieces.upto").alias("ends"),
        F.col("_pieces._piece").alias("pieces"),
    )
