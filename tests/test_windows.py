import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sonoframe.operators import windows as W


def simulate(sizes, chunk, stride):
    """Brute force: a growing list of samples from which windows are taken one by one."""
    samples, taken, appended = [], 0, []
    counter = 0
    for i, n in enumerate(sizes):
        samples += list(range(counter, counter + n))
        counter += n
        while len(samples) - taken * stride >= chunk:
            begin = taken * stride
            appended.append((i, taken, begin, begin + chunk))
            taken += 1
    rest = samples[taken * stride :]
    return appended, (taken, taken * stride, counter) if rest else None


def chunk_table(spark, sessions):
    rows = [(s, i, n) for s, sizes in sessions.items() for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "session string, seq long, n long")


def run(spark, sessions, chunk, stride):
    df = chunk_table(spark, sessions)
    appended = W.append_windows(W.chunk_offsets(df, ["session"], "seq", "n"), chunk, stride)
    flushed = W.flush_windows(df, ["session"], "n", chunk, stride)
    a = {}
    for r in sorted(appended.select("session", "seq", "win_idx", "start", "end").collect()):
        a.setdefault(r[0], []).append(tuple(r)[1:])
    f = {r["session"]: (r["win_idx"], r["start"], r["end"]) for r in flushed.collect()}
    return a, f


@pytest.mark.parametrize(
    "chunk,stride,sizes,windows,rest",
    [
        (5, 2, [7, 6], [(0, 5), (2, 7), (4, 9), (6, 11), (8, 13)], (10, 13)),
        (5, 2, [3], [], (0, 3)),
        (5, 5, [5], [(0, 5)], None),
    ],
)
def test_literal(spark, chunk, stride, sizes, windows, rest):
    a, f = run(spark, {"s": sizes}, chunk, stride)
    assert [w[2:] for w in a.get("s", [])] == windows
    assert (f["s"][1:] if "s" in f else None) == rest


def test_random_sessions(spark):
    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
    @given(
        st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.lists(st.integers(0, 40), min_size=1, max_size=15), min_size=5, max_size=30),
        st.integers(1, 20), st.integers(1, 20),
    )
    def check(sessions, a, b):
        chunk, stride = max(a, b), min(a, b)
        got, rest = run(spark, sessions, chunk, stride)
        for s, sizes in sessions.items():
            want, left = simulate(sizes, chunk, stride)
            assert got.get(s, []) == want
            assert rest.get(s) == left

    check()


def test_sizes():
    assert W.window_sizes(5.0, 1.0, 16000) == (80000, 16000)
    assert W.window_sizes(0.99999, 0.5, 10) == (9, 5)
    for bad in ((0, 1, 16000), (5, 0, 16000), (1, 5, 16000), (5, 1e-5, 16000), (1e-5, 1e-5, 16000), (-1, -2, 1)):
        with pytest.raises(ValueError):
            W.window_sizes(*bad)


@pytest.mark.parametrize("chunk,stride", [(0, None), (30, None), (30, 30), (30, 7), (1, 1), (500, None)])
def test_recordings(spark, chunk, stride):
    lengths = [0, 1, 29, 30, 31, 60, 200]
    df = spark.createDataFrame([(n, [float(i) for i in range(n)]) for n in lengths], "n long, x array<float>")
    got, cut = {}, {}
    for r in W.recording_windows(df.select("n"), "n", chunk, stride).collect():
        got.setdefault(r["n"], []).append((r["win_idx"], r["start"], r["end"]))
    for r in W.slice_recordings(df, "x", chunk, stride).collect():
        cut.setdefault(r["n"], []).append((r["win_idx"], r["start"], r["end"]))
        assert r["samples"] == [float(i) for i in range(r["start"], r["end"])]
    for n in lengths:
        c, s = (chunk, stride or chunk) if chunk else (max(n, 1), max(n, 1))
        appended, rest = simulate([n], c, s)
        want = [w[1:] for w in appended] + ([rest] if rest else [])
        assert sorted(got.get(n, [])) == sorted(cut.get(n, [])) == want


@pytest.mark.parametrize("frame", [1, 4, 10, 64])
def test_frames(spark, frame):
    df = spark.createDataFrame([("u", [float(i) for i in range(53)]), ("v", [1.0] * 3), ("w", [])], "utt_id string, x array<float>")
    frames = W.to_frames(df, "x", frame)
    windows = W.recording_windows(df.select("utt_id", F.size("x").alias("n")), "n", 16, 4).drop("n")
    out = W.window_samples(windows, frames, ["utt_id"], frame)
    direct = W.slice_recordings(df, "x", 16, 4)
    key = lambda rows: sorted((r["utt_id"], r["win_idx"], r["start"], r["end"], r["samples"]) for r in rows)
    assert key(out.collect()) == key(direct.collect())
    for chunk, stride in ((16, 4), (16, None), (7, 7), (100, 3), (1, 1)):
        cut = W.cut_frames(frames, ["utt_id"], frame, chunk, stride)
        assert key(cut.collect()) == key(W.slice_recordings(df, "x", chunk, stride).collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("chunk,stride,per_span", [(8, 3, 1), (8, 3, 4), (5, 5, 3), (100, 1, 64)])
def test_chunk_spans(spark, chunk, stride, per_span):
    rng = np.random.default_rng(5)
    sessions = {f"s{i}": rng.integers(0, 30, rng.integers(1, 40)).tolist() for i in range(20)}
    sessions["none"] = [0, 0]
    rows, whole = [], {}
    for s, sizes in sessions.items():
        at = 0
        for i, n in enumerate(sizes):
            rows.append((s, i, np.arange(at, at + n, dtype="<f4").tobytes() if n else None, False))
            at += n
        rows.append((s, len(sizes), None, s != "s3"))
        whole[s] = np.arange(at, dtype="<f4")
    df = spark.createDataFrame(rows, "session string, seq long, payload binary, eos boolean")
    found = {}
    for r in W.chunk_spans(df, chunk, stride, per_span).collect():
        samples = whole[r["session"]][r["start"] : r["end"]]
        assert b"".join(r["pieces"]) == samples.tobytes()
        for i in range(r["n_win"]):
            begin = r["start"] + i * stride
            end = begin + chunk if r["kind"] == "partial" else r["end"]
            owner = r["seqs"][[e >= end for e in r["ends"]].index(True)]
            found.setdefault(r["session"], []).append((r["kind"], owner, r["first_win"] + i, begin, end))
    for s, sizes in sessions.items():
        appended, rest = simulate(sizes, chunk, stride)
        want = [("partial", *w) for w in appended]
        if rest and s != "s3":  # s3 never closes
            want.append(("final", len(sizes), *rest))
        assert sorted(found.get(s, [])) == sorted(want)
