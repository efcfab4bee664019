"""Line-first cleaning: every line is judged on its own, failing lines go, and a document
that loses too much of its text goes as a whole.

Built-in expressions only; all work stays inside a row, so nothing is shuffled. Words are
maximal runs of characters other than space and U+0009 to U+000D.

Defined results: a null text counts as empty; a text without words fails; rows with a null
or repeated id are judged like any other; an empty table gives an empty table. Other columns
are kept, unless they carry the name of a result column, which then replaces them.
"""

import string

from pyspark.sql import Column, DataFrame, functions as F

# Classes of single Latin characters are one table in Java; ranges are tried one after the other.
SPACE = r"[\x20\x09\x0A\x0B\x0C\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8  # words of a repeated window
MIN_KEPT_PERCENT = 50  # of the letters and digits of all words

# Line rules. A line is judged by counts, so the SQL beside the query can say the same.
CROWDED_PERCENT = 15  # punctuation among the characters of a line's words
CROWDED_WORDS = 3
LONG_LINE_WORDS = 40  # from here on, a line without any sentence end is a list or a table
SEPARATORS = r"[|»›•·]"
MIN_SEPARATORS = 3
# Phrases as whole words, in a form that Java's and DuckDB's expressions both understand.
BOILERPLATE = (
    r"(?i)(^|[^\p{L}\p{N}])(share (this|on) |(accept (all )?cookies|cookie (policy|settings)|privacy policy"
    r"|terms (of|and) (use|services?|conditions)|all rights reserved|enable javascript|skip to (main )?content|click here|sign (in|up)"
    r"|log ?in|subscribe (now|to)|read more|back to top|newsletters?)($|[^\p{L}\p{N}]))"
)
BOILERPLATE_HINT = (
    r"(?i)(cook|polic|terms|reserved|javascript|content|click|sign|log ?in|subscribe|share|read more|back to|newsletter)"
)  # quick to look for, and in every such phrase
BOILERPLATE_WORDS = 15  # longer lines only mention such a phrase
PUNCTUATION = "[" + "".join(f"\\x{ord(c):02X}" for c in string.punctuation) + "]"
# The sentence ends of all scripts.
SENTENCE_END = (
    r"[.!?…\x{037E}\x{0589}\x{061D}-\x{061F}\x{06D4}\x{0700}-\x{0702}\x{07F9}\x{0837}\x{0839}\x{083D}\x{083E}\x{0964}\x{0965}\x{0F0D}\x{0F0E}\x{104A}\x{104B}\x{1362}\x{1367}\x{1368}"
    r"\x{166E}\x{1735}\x{1736}\x{17D4}\x{17D5}\x{1803}\x{1809}\x{1944}\x{1945}\x{1AA8}-\x{1AAB}\x{1B4E}\x{1B4F}\x{1B5A}\x{1B5B}\x{1B5E}\x{1B5F}\x{1B7D}-\x{1B7F}\x{1C3B}\x{1C3C}\x{1C7E}\x{1C7F}"
    r"\x{203C}\x{203D}\x{2047}-\x{2049}\x{2CF9}-\x{2CFB}\x{2E2E}\x{2E3C}\x{2E53}\x{2E54}\x{3002}\x{A4FF}\x{A60E}\x{A60F}\x{A6F3}\x{A6F7}\x{A876}\x{A877}\x{A8CE}\x{A8CF}\x{A92F}\x{A9C8}\x{A9C9}"
    r"\x{AA5D}-\x{AA5F}\x{AAF0}\x{AAF1}\x{ABEB}\x{FE12}\x{FE15}\x{FE16}\x{FE52}\x{FE56}\x{FE57}\x{FF01}\x{FF0E}\x{FF1F}\x{FF61}\x{10A56}\x{10A57}\x{11047}\x{11048}"
    r"\x{110BE}-\x{110C1}\x{11141}-\x{11143}\x{111C5}\x{111C6}\x{111CD}\x{111DE}\x{111DF}\x{11238}\x{11239}\x{1123B}\x{1123C}\x{112A9}"
    r"\x{1144B}\x{1144C}\x{115C2}\x{115C3}\x{115C9}-\x{115D7}\x{11641}\x{11642}\x{1173C}-\x{1173E}\x{16A6E}\x{16A6F}\x{16AF5}"
    r"\x{16B37}\x{16B38}\x{16B44}\x{16E98}\x{1BC9F}\x{1DA88}]"
)
# The same set for Spark: a range in front of the rare ones settles ordinary letters before the list is gone through.
COMMON_SENTENCE_END = "[.!?…]"
RARE_SENTENCE_END = r"[\x{037E}-\x{1DA88}&&" + SENTENCE_END + "]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def ends_sentence(line: Column) -> Column:
    """Whether a line holds a sentence end of any script."""
    return line.rlike(COMMON_SENTENCE_END) | line.rlike(RARE_SENTENCE_END)


def letters(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def matches(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measured(line: Column) -> Column:
    """One line with the counts its rules ask for; each is computed once."""
    return F.struct(
        line.alias("line"),
        F.size(words_of(line)).alias("n_words"),
        letters(line).alias("chars"),
        matches(line, PUNCTUATION).alias("marks"),
        matches(line, SEPARATORS).alias("separators"),
    )


def line_fails(x: Column) -> Column:
    """Whether a measured line fails a rule. Lines without a word never do."""
    crowded = (x["n_words"] >= CROWDED_WORDS) & (x["marks"] * 100 > x["chars"] * CROWDED_PERCENT)
    unpunctuated = (x["n_words"] >= LONG_LINE_WORDS) & ~ends_sentence(x["line"])
    navigation = (x["separators"] >= MIN_SEPARATORS) & (x["separators"] * 4 >= x["n_words"])
    boilerplate = (x["n_words"] <= BOILERPLATE_WORDS) & x["line"].rlike(BOILERPLATE_HINT) & x["line"].rlike(BOILERPLATE)
    return (x["chars"] > 0) & (crowded | unpunctuated | navigation | boilerplate)


def repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Add how many words lie in windows of ``WINDOW`` words found twice or more.

    Windows are hashed. Most texts repeat none, which a hash set shows in one pass; only the
    others are sorted. A sorted list of (hash, place) has equal windows side by side, and the
    sorted places of those then cover the words they count once each. No step is quadratic.
    """
    whole = F.size(words) >= WINDOW
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    df = df.withColumn("_coded", F.transform(words, lambda w: F.xxhash64(w)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("_coded", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(whole, hashes)).drop("_coded")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    paired = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(repeats, paired)).drop("_windows")
    # The list is bound once by an outer lambda, so the inner one does not build it anew.
    doubled = F.flatten(
        F.transform(
            F.array("_sorted"),
            lambda s: F.filter(
                s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)
            ),
        )
    )
    df = df.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(doubled, lambda x: x["i"]))))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn(name, F.coalesce(F.when(F.col("_places").isNotNull(), covered), F.lit(0).cast("bigint"))).drop("_sorted", "_places")


RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines",
    "kept_chars", "clean_text", "base_failed", "kept",
]


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts, ``clean_text`` (the lines that pass, in order) and the verdict ``kept``."""
    own = [c for c in df.columns if c.lower() not in {*RESULTS, "_t", "_w", "_r"}]
    df = df.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words_of(F.col("_t")))
    df = repeated_words(df, "_w", "n_repeat_words")
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
            "n_symbols": matches(F.col("_t"), SYMBOLS).cast("bigint"),
            "_measured": F.transform(F.split("_t", "\n"), measured),
        }
    ).drop("_w")
    df = df.withColumns(
        {
            "_lines": F.transform(F.filter("_measured", lambda x: x["chars"] > 0), lambda x: x["line"]),
            "_judged": F.transform("_measured", lambda x: F.struct(x["line"].alias("line"), line_fails(x).alias("fails"))),
        }
    ).drop("_measured")
    passed = F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"])
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_failed_lines": F.size(F.filter("_judged", lambda x: x["fails"])).cast("bigint"),
            "clean_text": F.array_join(passed, "\n"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT),
        }
    )
    df = df.withColumn("kept_chars", letters(F.col("clean_text")).cast("bigint"))
    enough = F.col("kept_chars") * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT
    df = df.withColumn("kept", ~F.col("base_failed") & enough)
    # A generator ends the projection: a later filter on a result is not rewritten into all that made it.
    return df.select(*own, F.explode(F.array(F.struct(*RESULTS))).alias("_r")).select(*own, *[f"_r.{c}" for c in RESULTS])
