"""Recordings as files."""

import io
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonoframe.functions.audio import list_rows
from sonoframe.sources.files import expand
from sonoframe.sources.listing import is_known, opened


def encode_wave(samples: np.ndarray, rate: int) -> bytes:
    """Mono float samples in [-1, 1) as a PCM WAV file of 16 bits; what is louder is clipped."""
    frames = np.clip(np.floor(samples.astype(np.float64) * 32768), -32768, 32767).astype("<i2")
    with io.BytesIO() as content:
        with wave.open(content, "wb") as writer:
            writer.setnchannels(1)
            writer.setsampwidth(2)
            writer.setframerate(rate)
            writer.writeframes(frames.tobytes())
        return content.getvalue()


def write_waves(df: DataFrame, folder: str, rate: int, name: str = "name", samples: str = "samples") -> None:
    """One WAV file per row, written by the tasks to ``folder/name``. A file appears under its name when it is
    complete, and a task that runs again writes the same files."""
    folder = expand(folder)
    if not is_known(folder):
        raise ValueError(f"tasks cannot write to {folder}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, _ = opened(folder)
        made = set()
        for batch in batches:
            for path, array in zip(batch.column(0).to_pylist(), list_rows(batch.column(1)), strict=True):
                place = f"{root.rstrip('/')}/{path}"
                parent = place.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                unfinished = f"{parent}/_{uuid.uuid4().hex}"
                with system.open_output_stream(unfinished) as file:
                    file.write(encode_wave(array, rate))
                system.move(unfinished, place)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    rows = df.select(df[name].alias("name"), df[samples].cast("array<float>").alias("samples"))
    rows.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
