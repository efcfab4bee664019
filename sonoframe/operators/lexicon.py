"""Tokens and their ids.

A vocabulary is a table ``(token_id, token, is_special)``. It travels with the function that
looks tokens up: no join, no row per token. Its size does not grow with the corpus: Unicode
bounds a character vocabulary, and a recogniser's output layer any other.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sonoframe.functions.audio import list_rows
from sonoframe.schemas import VOCAB


def char_vocabulary(df: DataFrame, text: str, specials: tuple[str, ...] = ("<blank>", "<unk>")) -> DataFrame:
    """Special tokens first, then every character of the text in code point order.

    Each row is reduced to its distinct characters before any shuffle. Unicode has
    fewer than 1,114,112 characters, which bounds what reaches the driver.
    """
    characters = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("token")).filter("token != ''")
    tokens = sorted(row["token"] for row in characters.distinct().collect())
    rows = [(i, t, i < len(specials)) for i, t in enumerate([*specials, *tokens])]
    return df.sparkSession.createDataFrame(rows, VOCAB)


def _rows(vocab: DataFrame) -> list:
    return vocab.select("token_id", "token", "is_special").collect()


PIECE = 1 << 18  # characters or ids that are worked on together, or one row


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows that are worked on together, by their lengths."""
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // PIECE)) + 1
    bounds = [0, *cuts.tolist(), len(lengths)] if len(lengths) else []
    yield from zip(bounds[:-1], bounds[1:])


def character_ids(vocab: DataFrame, unknown: str = "<unk>") -> Callable[[pa.Array], pa.Array]:
    """Function from texts to lists of ids, unknown characters to the id of ``unknown``. Besides its result it holds
    little more than ``PIECE`` characters."""
    ids = {row["token"]: row["token_id"] for row in _rows(vocab)}
    by_code = {ord(t): i for t, i in ids.items() if len(t) == 1}
    # The last entry is for every character beyond the table.
    table = np.full(max(by_code, default=0) + 2, ids[unknown], np.int32)
    table[list(by_code)] = list(by_code.values())

    def encode(texts: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        found = np.empty(offsets[-1], np.int32)
        for begin, end in _pieces(lengths):
            joined = "".join([t or "" for t in texts.slice(begin, end - begin).to_pylist()])
            codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            found[offsets[begin] : offsets[end]] = table[np.minimum(codes, len(table) - 1)]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found), mask=texts.is_null())

    return encode


def _decoder(spoken_ids: np.ndarray, tokens: list[str], separator: str):
    """Arrow function from ids to text; ids that are not listed are skipped."""
    characters = bool(tokens) and not separator and all(len(t) == 1 for t in tokens)
    codes = np.array([ord(t) for t in tokens], "<u4") if characters else None

    def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(spoken_ids, ids), max(0, len(tokens) - 1))
        return at, spoken_ids[at] == ids if tokens else np.zeros(len(ids), bool)

    def joined(part: pa.Array) -> pa.Array:
        out = []
        for row in list_rows(part, fill=-1):
            if row is None:
                out.append(None)
                continue
            at, spoken = places(row)
            out.append(separator.join([tokens[i] for i in at[spoken]]))
        return pa.array(out, pa.string())

    def written(part: pa.Array, lengths: np.ndarray) -> pa.Array:
        """Tokens of one character, all rows at once."""
        at, spoken = places(part.flatten().fill_null(-1).to_numpy(zero_copy_only=False))
        points = codes[at[spoken]]
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        rows = np.concatenate(([0], np.cumsum(spoken)))[np.concatenate(([0], np.cumsum(lengths)))]
        offsets = np.concatenate(([0], np.cumsum(sizes)))[rows].astype(np.int32)
        content = points.tobytes().decode("utf-32-le").encode()
        texts = pa.StringArray.from_buffers(len(part), pa.py_buffer(offsets), pa.py_buffer(content))
        return pc.if_else(part.is_valid(), texts, pa.scalar(None, pa.string())) if part.null_count else texts

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for begin, end in _pieces(lengths):
            part = ids.slice(begin, end - begin)
            parts.append(written(part, lengths[begin:end]) if characters else joined(part))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode


def encode_characters(
    df: DataFrame, text: str, vocab: DataFrame, unknown: str = "<unk>", name: str = "labels"
) -> DataFrame:
    """Text to character ids, unknown characters to the id of ``unknown``. Rows and columns of ``df`` are kept."""
    return df.withColumn(name, F.arrow_udf(character_ids(vocab, unknown), T.ArrayType(T.IntegerType()))(F.col(text)))


def decode_ids(df: DataFrame, ids: str, vocab: DataFrame, separator: str = "", name: str = "text") -> DataFrame:
    """Ids to text; special tokens are skipped, as are ids the vocabulary lacks. Rows and columns of ``df`` are kept."""
    spoken = sorted((row["token_id"], row["token"]) for row in _rows(vocab) if not row["is_special"])
    numbers = np.array([i for i, _ in spoken], np.int64)
    return df.withColumn(name, _decoder(numbers, [t for _, t in spoken], separator)(F.col(ids)))
