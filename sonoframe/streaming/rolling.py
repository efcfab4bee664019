"""The rolling buffer of every live session, as keyed state.

A session's chunks are numbered 0, 1, 2, ... and its ``eos`` row takes the next
number. Chunks may arrive in any order and more than once: early ones wait in the
state, late ones are dropped, and a closed session ignores what still comes.

The state of a session is one small value (less than one window of samples) and a map with an entry for each chunk that
waits, so a chunk is written once and no value grows. A timer bounds both: a number that is missing for
``idle_timeout_ms`` is given up, and a session that is silent for so long is closed and forgotten.

The state only cuts samples into spans. The recogniser runs after it, on rows
that can be spread over all tasks.
"""

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonoframe.functions.audio import Resampler, convert_payload, linear_resampler, payload_is_whole
from sonoframe.functions.recognise import RecogniserFactory, spread, transcribe_spans
from sonoframe.operators.windows import window_sizes
from sonoframe.schemas import SPAN

BYTES = 4  # of one float32 sample
IDLE_TIMEOUT_MS = 3_600_000

# The state store that holds maps and timers; a fixed value of Spark.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_BUFFER = "seen bigint, done bigint, next_seq bigint, tail binary, closed boolean, n_waiting bigint, heard_ms bigint, gap_ms bigint, due_ms bigint"


class Buffer(NamedTuple):
    """What is kept of a session besides the chunks that wait."""

    seen: int = 0
    done: int = 0
    next_seq: int = 0
    tail: bytes = b""  # starts at sample done * stride
    closed: bool = False
    n_waiting: int = 0
    heard_ms: int = 0  # when a row came last
    gap_ms: int = 0  # when chunks began to wait for the next number; 0: none waits
    due_ms: int = 0  # the timer that is set; 0: none


def take(key: str, buffer: Buffer, payload: bytes, eos: bool, chunk: int, stride: int) -> tuple[Buffer, list[tuple]]:
    """The next chunk of a session: the buffer after it, and the spans it completes."""
    seq, spans = buffer.next_seq, []
    seen, done, tail = buffer.seen + len(payload) // BYTES, buffer.done, buffer.tail + payload
    ready = 0 if seen < chunk else (seen - chunk) // stride + 1
    if ready > done:
        start, length = done * stride, (ready - done - 1) * stride + chunk
        spans.append((key, seq, "partial", done, ready - done, start, start + length, tail[: length * BYTES]))
        tail, done = tail[(ready - done) * stride * BYTES :], ready
    buffer = buffer._replace(seen=seen, done=done, tail=tail, next_seq=seq + 1)
    if eos:
        buffer, last = close(key, buffer, seq, stride)
        spans += last
    return buffer, spans


def close(key: str, buffer: Buffer, seq: int, stride: int) -> tuple[Buffer, list[tuple]]:
    """End a session; what is left in the buffer is one last window."""
    done, seen, tail = buffer.done, buffer.seen, buffer.tail
    spans = [(key, seq, "final", done, 1, done * stride, seen, tail)] if tail else []
    return buffer._replace(seen=0, done=0, tail=b"", closed=True), spans


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=SPAN.names)


class RollingBuffer(StatefulProcessor):
    def __init__(self, chunk: int, stride: int, idle_timeout_ms: int | None) -> None:
        self.chunk, self.stride, self.idle_ms = chunk, stride, idle_timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getValueState("buffer", _BUFFER)
        self.waiting = handle.getMapState("waiting", "seq bigint", "payload binary, eos boolean")

    def _load(self) -> Buffer:
        held = self.buffer.get()
        return Buffer() if held is None else Buffer(*held)._replace(tail=bytes(held[3] or b""))

    def _drain(self, key: str, buffer: Buffer, spans: list[tuple]) -> Buffer:
        """Take waiting chunks as long as the next number is among them."""
        while buffer.n_waiting and not buffer.closed:
            held = self.waiting.getValue((buffer.next_seq,))
            if held is None:
                break
            self.waiting.removeKey((buffer.next_seq,))
            buffer, more = take(key, buffer._replace(n_waiting=buffer.n_waiting - 1), bytes(held[0] or b""), bool(held[1]), self.chunk, self.stride)
            spans += more
        return buffer

    def _settled(self, buffer: Buffer, now: int) -> Buffer:
        """Note since when a number is missing, empty the map of a closed session, and see that a timer is set."""
        if buffer.closed and buffer.n_waiting:
            self.waiting.clear()
            buffer = buffer._replace(n_waiting=0)
        buffer = buffer._replace(gap_ms=(buffer.gap_ms or now) if buffer.n_waiting else 0)
        if self.idle_ms and not buffer.due_ms:
            buffer = buffer._replace(due_ms=(buffer.gap_ms or buffer.heard_ms) + self.idle_ms)
            if buffer.due_ms <= now:
                buffer = buffer._replace(due_ms=now + 1)
            self.handle.registerTimer(buffer.due_ms)
        return buffer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(0, timerValues.getCurrentProcessingTimeInMs())
        buffer = self._load()._replace(heard_ms=now)
        for batch in rows:
            spans: list[tuple] = []
            # In order within a batch, few chunks have to wait; the first of equal numbers counts.
            batch = batch.sort_values("seq", kind="stable")
            for seq, payload, eos in zip(batch["seq"].tolist(), batch["payload"], batch["eos"].tolist(), strict=True):
                if buffer.closed:
                    break
                if seq == buffer.next_seq:
                    held = buffer.next_seq
                    buffer, more = take(key[0], buffer, bytes(payload or b""), bool(eos), self.chunk, self.stride)
                    spans += more
                    if buffer.n_waiting and self.waiting.containsKey((held,)):
                        self.waiting.removeKey((held,))
                        buffer = buffer._replace(n_waiting=buffer.n_waiting - 1)
                    buffer = self._drain(key[0], buffer._replace(gap_ms=0), spans)
                elif seq > buffer.next_seq and not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (bytes(payload or b""), bool(eos)))
                    buffer = buffer._replace(n_waiting=buffer.n_waiting + 1)
            yield _frame(spans)
        self.buffer.update(tuple(self._settled(buffer, now)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        buffer, spans = self._load()._replace(due_ms=0), []
        silent = now - buffer.heard_ms >= self.idle_ms
        while not buffer.closed and buffer.n_waiting and (silent or now - buffer.gap_ms >= self.idle_ms):
            # The missing numbers are given up, so none of the chunks behind them is thrown away.
            nearest = min(k[0] for k in self.waiting.keys())
            buffer = self._drain(key[0], buffer._replace(next_seq=nearest), spans)
            if not silent:
                buffer = buffer._replace(gap_ms=now)
                break
        if silent:
            if not buffer.closed:
                spans += close(key[0], buffer, buffer.next_seq, self.stride)[1]
            self.buffer.clear()
            self.waiting.clear()
        else:
            self.buffer.update(tuple(self._settled(buffer, now)))
        yield _frame(spans)

    def close(self) -> None:
        pass


def stream_spans(chunks: DataFrame, chunk: int, stride: int, idle_timeout_ms: int | None = IDLE_TIMEOUT_MS) -> DataFrame:
    """Spans that each chunk completes, and the final span of each session.

    A payload that is not a whole number of samples counts as a chunk without
    samples. ``idle_timeout_ms`` closes sessions that end without an ``eos`` row
    and, that long after closing, forgets them; a chunk that is missing for so long is passed over. ``None`` waits for ever.
    The session's state store becomes RocksDB, the one that has maps and timers.
    """
    chunks.sparkSession.conf.set(STORE_SETTING, STORE)
    whole = F.when(payload_is_whole(F.col("payload")), F.col("payload"))
    rows = chunks.select("session", "seq", whole.alias("payload"), F.coalesce("eos", F.lit(False)).alias("eos"))
    spans = rows.groupBy("session").transformWithStateInPandas(
        RollingBuffer(chunk, stride, idle_timeout_ms), SPAN, "append", "ProcessingTime" if idle_timeout_ms else "None"
    )
    # The state operator hands out columnar rows, which a shuffle cannot write; any
    # real projection turns them into ordinary ones.
    return spans.withColumn("span", F.coalesce("span", F.lit(b"")))


def broken_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that are not a whole number of samples, to be kept apart for inspection."""
    return chunks.filter(~payload_is_whole(F.col("payload")))


def stream_transcribe(
    chunks: DataFrame,
    factory: RecogniserFactory,
    sampling_rate: int = 16000,
    chunk_s: float = 5.0,
    stride_s: float = 1.0,
    idle_timeout_ms: int | None = IDLE_TIMEOUT_MS,
    spread_work: bool = True,
    source_rate: int | None = None,
    channels: int = 1,
    resampler: Resampler = linear_resampler,
) -> DataFrame:
    """Messages of all sessions: a ``partial`` per chunk that completes windows with
    text, and a ``final`` when a session ends with samples left. Chunks at another
    rate, or with several channels, are converted one by one before they are buffered."""
    chunk, stride = window_sizes(chunk_s, stride_s, sampling_rate)
    payload = convert_payload(F.col("payload"), source_rate or sampling_rate, sampling_rate, channels, resampler)
    chunks = chunks.withColumn("payload", payload)
    spans = stream_spans(chunks, chunk, stride, idle_timeout_ms)
    if spread_work:
        spans = spread(spans, "session", "seq")
    return transcribe_spans(spans, factory, sampling_rate, chunk, stride).drop("win_idx")
