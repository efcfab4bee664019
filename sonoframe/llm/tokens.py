"""Token ids of whole texts, in Arrow batches.

The vocabulary is a byte-level BPE whose pre-tokens never reach from a visible character over
a space. So a text is cut before every single space, the distinct pieces of a batch are encoded
once, and the ids are gathered back. Texts where a space touches other white space, or that hold
a special token, are encoded whole: their pieces would not be independent.
"""

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

JSON_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
REMEMBERED = 200_000  # pieces whose ids a worker keeps (about 50 MB, also after its stage); then it starts anew
SLICE_BYTES = 8 << 20  # of text encoded at once, or one text

# The characters that count as white space for the vocabulary's pre-tokens.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ENTANGLED = rf" {WHITE}|{WHITE} |<\|endoftext\|>"


@functools.cache
def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(JSON_FILE))


@functools.cache
def ranks() -> tiktoken.Encoding:
    with open(public_tokenizers.path(RANKS_FILE), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


_known: dict[str, bytes] = {}


def _piece_ids(pieces: list[str]) -> list[bytes]:
    if len(_known) > REMEMBERED:
        _known.clear()
    encode, found = ranks().encode_ordinary, []
    for piece in pieces:
        ids = _known.get(piece)
        if ids is None:
            ids = _known[piece] = array("i", encode(piece)).tobytes()
        found.append(ids)
    return found


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of every range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``SLICE_BYTES``."""
    begin, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > SLICE_BYTES:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def token_ids(texts: pa.Array) -> list[np.ndarray]:
    """Ids of every text; a null text has none."""
    texts = texts.cast(pa.string())
    return [ids for a, b in slices(texts) for ids in _slice_ids(texts.slice(a, b - a))]


def _slice_ids(texts: pa.Array) -> list[np.ndarray]:
    entangled = pc.fill_null(pc.match_substring_regex(texts, ENTANGLED), False)
    apart = pc.invert(entangled)
    pieces = pc.split_pattern(texts.filter(apart), " ")
    counts = np.zeros(len(texts), np.int64)
    counts[apart.to_numpy(zero_copy_only=False)] = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    coded = pieces.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary.to_pylist()
    # The first piece of a text has no space before it: it gets a code of its own.
    bounds = np.concatenate(([0], np.cumsum(counts)))
    firsts = bounds[:-1][counts > 0]
    opening = [words[c] for c in codes[firsts].tolist()]
    place = {w: len(words) + i for i, w in enumerate(dict.fromkeys(opening))}
    codes[firsts] = [place[w] for w in opening]
    table = _piece_ids([*map(" ".__add__, words), *place])
    lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
    flat = np.frombuffer(b"".join(table), np.int32)
    each = lengths[codes]
    ids = flat[ragged((np.cumsum(lengths) - lengths)[codes], each)]
    ends = np.concatenate(([0], np.cumsum(each)))[bounds]
    out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for i in np.flatnonzero(entangled.to_numpy(zero_copy_only=False)).tolist():
        out[i] = np.array(tokenizer().encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
    return out
