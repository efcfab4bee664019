"""Text functions, ``Column -> Column``.

Everything runs inside the JVM except canonical composition (NFC), which Spark
does not have. That one goes through an Arrow function, and only the rows that
can change are sent to it.
"""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# --- fixed values -----------------------------------------------------------
# White space as Python defines it for str.strip() and \s (29 code points).
# Java's own \s is ASCII only, so the set is always spelled out.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Punctuation that a transcript loses; every other symbol stays.
PUNCTUATION = ".,?!:-;()[]{}\"'"
# Line breaks of str.splitlines() that Spark's text reader does not split on.
EXTRA_LINE_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Code points that never change under NFC, neither alone nor next to each other.
# A text made of these alone is left as it is.
NFC_INERT_RANGES = (
    (0x0000, 0x012F),
    (0x0131, 0x02FF),
    (0x0400, 0x0482),
    (0x1E00, 0x1EFF),
    (0x2010, 0x205E),
    (0x3041, 0x3098),
    (0x309B, 0x30FF),
    (0x4E00, 0x9FFF),
    (0xAC00, 0xD7A3),
    (0x1F300, 0x1FAFF),
)
# ----------------------------------------------------------------------------


def char_class(chars: str) -> str:
    """Body of a regular-expression class; neighbours become ranges, which Java tests faster."""
    codes = sorted({ord(c) for c in chars})
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


WHITESPACE_RUN = f"[{char_class(WHITESPACE)}]+"
LINE_BREAK = f"[{char_class(EXTRA_LINE_BREAKS)}]"
_MAY_CHANGE_UNDER_NFC = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in NFC_INERT_RANGES) + "]"


@F.arrow_udf(T.StringType())
def _compose(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()],
        pa.string(),
    )


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def lower(text: Column) -> Column:
    return F.lower(text)


def punctuation_to_space(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE_RUN, " ")


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return _nfc_where_needed(text, text)


def _nfc_where_needed(source: Column, derived: Column) -> Column:
    """NFC of ``derived``, given that ``derived`` is inert whenever ``source`` is.

    The Arrow function sees NULL for inert rows, so their text is never shipped to
    Python, and the native value is then used; each row computes ``derived`` once.
    """
    return F.coalesce(_compose(F.when(source.rlike(_MAY_CHANGE_UNDER_NFC), derived)), derived)


def normalize_transcript(text: Column) -> Column:
    """Lower case, punctuation to spaces, NFC, single spaces, no outer spaces.

    NFC turns no character into white space that was not white space before, so
    white space can become plain spaces in the same pass that drops the punctuation;
    ``translate`` does that several times faster than a regular expression. The
    punctuation itself must go first: NFC maps U+037E to a semicolon, which stays.
    """
    blanked = PUNCTUATION + WHITESPACE
    spaced = F.translate(F.lower(text), blanked, " " * len(blanked))
    return F.trim(_nfc_where_needed(text, F.regexp_replace(spaced, " {2,}", " ")))


def split_first_word(line: Column) -> Column:
    """``[first word, rest]``; one element only when there is no second word."""
    return F.split(strip(line), WHITESPACE_RUN, 2)


def default_text(text: Column) -> Column:
    """Missing text reads as empty; outer white space goes."""
    return strip(F.coalesce(text, F.lit("")))


def wave_name(number: Column) -> Column:
    """File name of a numbered utterance: five digits, more when needed."""
    return F.format_string("utt_%05d.wav", number)


def segment_label(start: Column, end: Column, text: Column) -> Column:
    """``[start-end] text`` with two decimals; a missing time is 0.00.

    ``format_number`` rounds the binary value like Python's ``%.2f`` does;
    ``format_string`` rounds the decimal rendering and would print 0.125 as 0.13.
    """

    def seconds(value: Column) -> Column:
        number = F.coalesce(value.cast("double"), F.lit(0.0))
        return F.call_function("format_number", number, F.lit("0.00"))

    return F.concat(F.lit("["), seconds(start), F.lit("-"), seconds(end), F.lit("] "), default_text(text))


def local_path(path: Column) -> Column:
    """Path without the ``file:`` scheme; other schemes are kept."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def path_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?s)(?<=.)\.[^.]+\z", "")


def first_part_below(path: Column, root: str) -> Column:
    """First path component under ``root`` (the file name itself if it lies there)."""
    prefix = root if root.endswith("/") else root + "/"
    at = F.locate(prefix, path)
    tail = F.substring(path, at + F.lit(len(prefix)), F.length(path))
    return F.when(at > 0, F.substring_index(tail, "/", 1))
