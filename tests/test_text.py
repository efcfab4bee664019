import re
import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sonoframe.functions import text as X

SPACES = X.WHITESPACE


def expected_transcript(text):
    """Brute-force statement of the rules, one step at a time."""
    if not text:
        return text
    step = text.strip().lower()
    step = "".join(" " if c in X.PUNCTUATION else c for c in step)
    step = unicodedata.normalize("NFC", step)
    return " ".join(step.split())


def run(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, s string").select("i", fn(F.col("s")).alias("o")).collect()
    return [r["o"] for r in sorted(out, key=lambda r: r["i"])]


def test_whitespace_is_pythons():
    assert set(X.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_line_breaks_are_pythons():
    every = {chr(i) for i in range(0x110000) if len(f"a{chr(i)}b".splitlines()) == 2}
    assert set(X.EXTRA_LINE_BREAKS) | {"\n", "\r"} == every


def test_inert_ranges_never_change_under_nfc():
    inert = {chr(c) for a, b in X.NFC_INERT_RANGES for c in range(a, b + 1)}
    composing = set()
    for c in range(0x110000):
        d = unicodedata.decomposition(chr(c))
        if d and not d.startswith("<"):
            composing.update(chr(int(p, 16)) for p in d.split()[1:])
    composing.update(chr(c) for c in list(range(0x1161, 0x1176)) + list(range(0x11A8, 0x11C3)))
    for c in inert | {x for i in inert for x in i.lower()}:
        assert unicodedata.combining(c) == 0
        assert unicodedata.normalize("NFC", c) == c
        assert c not in composing


def test_literal_cases(spark):
    cases = {
        "  Xin chào, Đây  là ": "xin chào đây là",
        unicodedata.normalize("NFD", "Tiếng Việt Đường"): unicodedata.normalize("NFC", "tiếng việt đường"),
        "a b": "a b",
        "　a b　": "a b",
        "a\x1cb": "a b",
        "a b": "a b",
        "a\x85b": "a b",
        "a​b": "a​b",
        "﻿Xin": "﻿xin",
        "a_b@c#d/e": "a_b@c#d/e",
        "“q”—x…": "“q”—x…",
        "...": "",
        "": "",
        "a;b": "a;b",
        "İ": "i̇",
        " x ": "x",
    }
    assert run(spark, X.normalize_transcript, cases) == list(cases.values())
    assert run(spark, X.normalize_transcript, [None]) == [None]


def test_single_steps(spark):
    odd = ["　 a \x1f", "", " ", None, "a\x85"]
    assert run(spark, X.strip, odd) == ["a", "", "", None, "a"]
    assert run(spark, X.punctuation_to_space, ["a.b-c_d\"'"]) == ["a b c_d  "]
    assert run(spark, X.collapse_whitespace, ["a \n b"]) == ["a b"]
    assert run(spark, X.nfc, ["é", "é", None]) == ["é", "é", None]
    assert run(spark, X.default_text, [None, " x "]) == ["", "x"]


alphabet = st.one_of(
    st.sampled_from(list(SPACES + X.PUNCTUATION + "̛̣́̂İßΣσẞ﻿;`ÅK한한“”…—ĐđeoaAEO😀")),
    st.characters(codec="utf-8", exclude_categories=("Cs", "Cn")),
)


def test_random_strings_against_brute_force(spark):
    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
    @given(st.lists(st.text(alphabet, max_size=24), min_size=150, max_size=300))
    def check(values):
        got = run(spark, X.normalize_transcript, values)
        for value, result in zip(values, got):
            assert result == expected_transcript(value), ascii(value)

    check()


def test_documents_against_brute_force(spark, docs):
    for row in docs.select("text", X.normalize_transcript(F.col("text")).alias("o")).collect():
        assert row["o"] == expected_transcript(row["text"])


def test_split_first_word(spark):
    got = run(spark, X.split_first_word, ["A X Y", "", "B", "A 　 LAST ", " C\tz  z "])
    assert got == [["A", "X Y"], [""], ["B"], ["A", "LAST"], ["C", "z  z"]]


def test_segment_label(spark):
    rows = [(0.125, 2.675, " x "), (None, None, ""), (1.0, 12345.678, None), (0.005, 0.015, "y")]
    df = spark.createDataFrame(rows, "a double, b double, t string")
    got = [r[0] for r in df.select(X.segment_label(F.col("a"), F.col("b"), F.col("t"))).collect()]
    want = [f"[{(a or 0.0):.2f}-{(b or 0.0):.2f}] {(t or '').strip()}" for a, b, t in rows]
    assert got == want
    assert got[:2] == ["[0.12-2.67] x", "[0.00-0.00] "]


def test_paths_and_names(spark):
    from pathlib import PurePosixPath

    names = ["/r/waves/SP 1/a%b é.wav", "/r/waves/R.wav", "/r/waves/.wav", "/r/waves/S/T/x.y.wav", "/r/waves/S/none"]
    assert run(spark, X.path_stem, names) == [PurePosixPath(n).stem for n in names]
    first = run(spark, lambda c: X.first_part_below(c, "/r/waves/"), names)
    assert first == [PurePosixPath(n).relative_to("/r/waves").parts[0] for n in names]
    assert run(spark, X.local_path, ["file:/a/b", "file:///a", "s3://k/file:/x"]) == ["/a/b", "/a", "s3://k/file:/x"]
    out = spark.createDataFrame([(7,), (99999,), (123456,)], "n long").select(X.wave_name(F.col("n"))).collect()
    assert [r[0] for r in out] == ["utt_00007.wav", "utt_99999.wav", "utt_123456.wav"]


def test_normaliser_plan_ships_only_risky_rows(spark, docs):
    plan = docs.filter("lang = 'en'").select(X.normalize_transcript(F.col("text")).alias("t"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and "BatchEvalPython" not in text
    assert "RLIKE" in text.upper()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text
