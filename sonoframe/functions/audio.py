"""Sample-level functions, vectorised over Arrow batches."""

import io
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

SAMPLES = T.ArrayType(T.FloatType(), True)
Resampler = Callable[[np.ndarray, int, int], np.ndarray]


def list_rows(column: pa.Array, fill: int | None = None) -> list[np.ndarray | None]:
    """NumPy view of every row of a list column; ``fill`` stands for NULL elements."""
    values = column.values if fill is None else column.values.fill_null(fill)
    values = values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return [
        values[offsets[i] : offsets[i + 1]] if valid else None
        for i, valid in enumerate(column.is_valid().to_pylist())
    ]


def to_list_column(rows: list[np.ndarray | None]) -> pa.Array:
    """float32 list column of NumPy rows."""
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    filled = [np.asarray(r, dtype=np.float32) for r in rows if r is not None]
    values = pa.array(np.concatenate(filled) if filled else np.zeros(0, np.float32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([r is None for r in rows], pa.bool_()))


@F.arrow_udf(SAMPLES)
def _unpack(payload: pa.Array) -> pa.Array:
    usable = pc.equal(pc.bit_wise_and(pc.binary_length(payload), 3), 0)
    payload = pc.if_else(pc.fill_null(usable, False), payload, pa.scalar(None, payload.type))
    rows = [None if p is None else np.frombuffer(p, dtype="<f4") for p in payload.to_pylist()]
    return to_list_column(rows)


@F.arrow_udf(T.BinaryType())
def _pack(samples: pa.Array) -> pa.Array:
    values = samples.flatten().cast(pa.float32()).fill_null(float("nan")).to_numpy().astype("<f4", copy=False)
    sizes = pc.fill_null(pc.list_value_length(samples), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 4
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(samples), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pc.if_else(samples.is_valid(), packed, pa.scalar(None, pa.binary())) if samples.null_count else packed


def unpack_samples(payload: Column) -> Column:
    """Packed little-endian float32 to an array; NULL if the length is no multiple of 4."""
    return _unpack(payload)


def pack_samples(samples: Column) -> Column:
    """Array of samples to packed little-endian float32."""
    return _pack(samples.cast("array<float>"))


def payload_is_whole(payload: Column) -> Column:
    return F.length(payload) % 4 == 0


def linear_resampler(samples: np.ndarray, from_rate: int, to_rate: int) -> np.ndarray:
    """Linear interpolation in double precision. Fine for moderate changes of rate; to
    go down far, pass a band-limited resampler instead."""
    n = len(samples)
    if from_rate == to_rate or n == 0:
        return samples
    return interpolated(samples, 0, n, 0, -(-n * to_rate // from_rate), from_rate, to_rate)


def sources_of(start: int, end: int, total: int, from_rate: int, to_rate: int) -> tuple[int, int]:
    """The samples of a recording of ``total`` that its samples ``start .. end - 1`` at another rate are made of."""
    if from_rate == to_rate or end <= start:
        return start, end
    return int(np.floor(start * from_rate / to_rate)), min(int(np.floor((end - 1) * from_rate / to_rate)) + 2, total)


def interpolated(samples: np.ndarray, first: int, total: int, start: int, end: int, from_rate: int, to_rate: int) -> np.ndarray:
    """Samples ``start .. end - 1`` at another rate, from the part of a recording that begins at its sample ``first``."""
    x = samples.astype(np.float64)
    position = np.arange(start, end, dtype=np.int64) * from_rate / to_rate
    low = np.floor(position).astype(np.int64)
    high = np.minimum(low + 1, total - 1)
    return (x[low - first] + (position - low) * (x[high - first] - x[low - first])).astype(np.float32)


def resample(
    samples: Column, from_rate: Column | int, to_rate: int, resampler: Resampler = linear_resampler
) -> Column:
    """Samples at another rate; unchanged if the rates are equal."""

    @F.arrow_udf(SAMPLES)
    def convert(arrays: pa.Array, rates: pa.Array) -> pa.Array:
        return to_list_column(
            [
                r if r is None or rate == to_rate else resampler(r, rate, to_rate)
                for r, rate in zip(list_rows(arrays), rates.to_pylist())
            ]
        )

    rate = F.lit(from_rate) if isinstance(from_rate, int) else from_rate
    if isinstance(from_rate, int) and from_rate == to_rate:
        return samples.cast("array<float>")
    return convert(samples.cast("array<float>"), rate.cast("int"))


def convert_payload(
    payload: Column, from_rate: int, to_rate: int, channels: int = 1, resampler: Resampler = linear_resampler
) -> Column:
    """Packed chunk at another rate and in mono. Several channels come one after the
    other; each is resampled before they are averaged. A payload that is not a whole
    number of samples per channel becomes NULL."""

    @F.arrow_udf(T.BinaryType())
    def convert(payloads: pa.Array) -> pa.Array:
        out = []
        for raw in payloads.to_pylist():
            if raw is None or len(raw) % (4 * channels):
                out.append(None)
                continue
            parts = np.frombuffer(raw, "<f4").reshape(channels, -1)
            if from_rate != to_rate:
                parts = np.stack([resampler(part, from_rate, to_rate) for part in parts])
            out.append(parts.mean(axis=0).astype("<f4").tobytes())
        return pa.array(out, pa.binary())

    return payload if from_rate == to_rate and channels == 1 else convert(payload)


def downmix(channels: Column) -> Column:
    """Mean over channels of ``array<array<float>>``, channels first, JVM-side."""
    x = channels.cast("array<array<double>>")
    added = F.aggregate(
        F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))),
        F.get(x, F.lit(0)),
        lambda total, channel: F.zip_with(total, channel, lambda a, b: a + b),
    )
    return F.transform(added, lambda v: (v / F.size(channels)).cast("float"))


def decode_frames(raw: bytes, width: int, channels: int) -> np.ndarray:
    """PCM frames of 8, 16, 24 or 32 bits a sample to mono float32 in [-1, 1)."""
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / np.float32(128)
    elif width == 3:
        triples = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        shifted = np.zeros((len(triples), 4), np.uint8)
        shifted[:, 1:] = triples
        samples = (shifted.view("<i4").reshape(-1) / 2.0**31).astype(np.float32)
    else:
        samples = (np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)).astype(np.float32)
    return samples.reshape(-1, channels).mean(axis=1) if channels > 1 else samples


def decode_wave(content: bytes) -> tuple[np.ndarray, int]:
    """A PCM WAV file to mono float32 in [-1, 1) and its rate."""
    with wave.open(io.BytesIO(content)) as reader:
        raw = reader.readframes(reader.getnframes())
        return decode_frames(raw, reader.getsampwidth(), reader.getnchannels()), reader.getframerate()


AUDIO_CELL = T.StructType([T.StructField("array", SAMPLES), T.StructField("sampling_rate", T.IntegerType())])


def decode_audio(content: Column, target_sr: int | None = None, resampler: Resampler = linear_resampler) -> Column:
    """Bytes of a PCM WAV file held in a column to ``struct(array, sampling_rate)``."""

    @F.arrow_udf(AUDIO_CELL)
    def decode(files: pa.Array) -> pa.Array:
        arrays, rates = [], []
        for file in files.to_pylist():
            samples, rate = (None, None) if file is None else decode_wave(file)
            if samples is not None and target_sr and rate != target_sr:
                samples, rate = resampler(samples, rate, target_sr), target_sr
            arrays.append(samples)
            rates.append(rate)
        columns = [to_list_column(arrays), pa.array(rates, pa.int32())]
        return pa.StructArray.from_arrays(columns, AUDIO_CELL.names)

    return decode(content)
