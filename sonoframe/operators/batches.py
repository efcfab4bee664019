"""Padded batches formed where the rows are.

A batch is some neighbouring rows of one task, so nothing has to move to form one: a single pass over the task's rows
holds a batch, learns its longest row, pads all of its columns and goes on. Samples and features are never shuffled.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from sonoframe.functions.arrays import IGNORED_LABEL
from sonoframe.operators.labels import LABEL_MULTIPLE

MOST_VALUES = 1 << 20  # padded values of a column that are built together, or one batch
SLICE_BYTES = 4 << 20  # of an Arrow batch looked at together, or one row
TASK_BITS = 33  # a batch id is a task's number, shifted by so much, plus a running number


def _lengths(column: pa.Array) -> np.ndarray:
    """Elements of each row; a missing row has none."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)


def _flat(column: pa.Array) -> np.ndarray:
    """All values of a list column, one row after the other."""
    values = column.flatten()
    if values.null_count:
        raise ValueError("labels and features must not hold missing values")
    return values.to_numpy(zero_copy_only=False)


def _scattered(values: np.ndarray, lengths: np.ndarray, targets: np.ndarray, fill: float) -> np.ndarray:
    """Rows of ``lengths`` values, each filled up to its target."""
    ends = np.cumsum(lengths)
    place = np.arange(len(values)) - np.repeat(ends - lengths, lengths) + np.repeat(np.cumsum(targets) - targets, lengths)
    out = np.full(int(targets.sum()), fill, values.dtype)
    out[place] = values
    return out


def _as_lists(values: pa.Array, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=None if missing is None or not missing.any() else pa.array(missing))


def padded_column(column: pa.Array, targets: np.ndarray, fill: float, masked: int | None = None) -> pa.Array:
    """A list column, or one of lists of equal width, with every present row filled up to its target. Cells
    equal to ``masked`` become the ignored label."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    lengths, targets = _lengths(column), np.where(missing, 0, targets)
    if not pa.types.is_list(column.type.value_type):
        values = _scattered(_flat(column), lengths, targets, fill)
        if masked is not None:
            values[values == masked] = IGNORED_LABEL
        return _as_lists(pa.array(values, column.type.value_type), targets, missing)
    frames = column.flatten()
    widths = np.unique(_lengths(frames))
    if len(widths) > 1 or frames.null_count:
        raise ValueError("all feature frames of a batch must have one width")
    width = int(widths[0]) if len(widths) else 0
    values = _scattered(_flat(frames), lengths * width, targets * width, fill)
    inner = _as_lists(pa.array(values, column.type.value_type.value_type), np.full(int(targets.sum()), width))
    return _as_lists(inner, targets, missing)


def form_batches(
    df: DataFrame,
    batch_size: int,
    labels: str = "labels",
    features: str | None = None,
    mode: str = "ctc",
    pad_id: int | None = None,
    multiple: int | None = LABEL_MULTIPLE,
    value: float = 0.0,
    attention_mask: bool = True,
    name: str = "batch_id",
    encode: Callable[[pa.Array], pa.Array] | None = None,
) -> DataFrame:
    """``df`` in batches of ``batch_size`` neighbouring rows, padded: adds ``batch_id``, ``label_length`` and,
    with features (one value or one list of them per frame), ``input_length``, the lengths before padding.

    Labels are masked as ``pad_labels`` does. With ``encode`` the column of labels holds texts, and that function makes lists of
    ids of them in the same pass, a slice of rows at a time. Nothing is shuffled. The last batch of a task may be short; a missing
    row of labels or features stays missing.
    """
    if mode not in ("ctc", "seq2seq"):
        raise ValueError("mode must be ctc or seq2seq")
    if mode == "seq2seq" and pad_id is None:
        raise ValueError("seq2seq labels need pad_id")
    if batch_size < 1:
        raise ValueError("a batch holds at least one row")
    masked = pad_id if mode == "seq2seq" or not attention_mask else None
    lengths = [("label_length", labels), *([("input_length", features)] if features else [])]
    own = [f for f in df.schema.fields if f.name not in (name, *[n for n, _ in lengths])]
    if encode:
        own = [T.StructField(labels, T.ArrayType(T.IntegerType())) if f.name == labels else f for f in own]
    schema = T.StructType([*own, T.StructField(name, T.LongType()), *[T.StructField(n, T.IntegerType()) for n, _ in lengths]])
    names = [f.name for f in own]
    rounded = multiple if mode == "seq2seq" and multiple else 1
    types = {f.name: f.dataType for f in own}
    if not all(isinstance(types[c], T.ArrayType) for _, c in lengths):
        raise TypeError("labels and features must be arrays")

    def padded(rows: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
        batch = np.arange(rows.num_rows) // batch_size
        starts = np.arange(0, rows.num_rows, batch_size)
        longest = {c: np.maximum.reduceat(_lengths(rows.column(c)), starts) for _, c in lengths}
        longest[labels] = -(-longest[labels] // rounded) * rounded
        sizes = np.diff(np.append(starts, rows.num_rows)) * np.max([longest[c] for _, c in lengths], axis=0)
        group = np.cumsum(sizes) // MOST_VALUES  # batches that are built together
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(starts)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            at, n = int(starts[begin]), min(end * batch_size, rows.num_rows) - int(starts[begin])
            part, of = rows.slice(at, n), batch[at : at + n]
            columns = {c: part.column(c) for c in names}
            told = [pa.array(_lengths(columns[c]), pa.int32(), mask=columns[c].is_null().to_numpy(zero_copy_only=False)) for _, c in lengths]
            for _, c in lengths:
                fill, gone = (IGNORED_LABEL, masked) if c == labels else (value, None)
                columns[c] = padded_column(columns[c], longest[c][of], fill, gone)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(first + of, pa.int64()), *told], schema.names)

    def sliced(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, rows.num_rows * SLICE_BYTES // max(1, rows.nbytes))
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            columns = {c: part.column(c) for c in names}
            if encode:
                columns[labels] = encode(columns[labels])
            yield pa.RecordBatch.from_arrays([*columns.values()], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, n_held = TaskContext.get().partitionId() << TASK_BITS, [], 0
        for rows in (part for batch in batches for part in sliced(batch)):
            held, n_held = [*held, rows], n_held + rows.num_rows
            whole = n_held // batch_size * batch_size
            if not whole:
                continue
            if len(held) > 1:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from padded(rows.slice(0, whole), made)
            # What is left is copied, so that it keeps no other rows in memory.
            left = rows.take(pa.array(np.arange(whole, n_held)))
            made, held, n_held = made + whole // batch_size, [left] if left.num_rows else [], left.num_rows
        if held:
            yield from padded(pa.Table.from_batches(held).combine_chunks().to_batches()[0], made)

    return df.mapInArrow(run, schema)
