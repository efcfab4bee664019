"""Listing of folder trees and recordings that are read in ranges."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions.audio import linear_resampler
from sonoframe.plans.transcribe import transcribe_files
from sonoframe.sinks.waves import encode_wave, write_waves
from sonoframe.sources import audio
from sonoframe.sources.audio import read_audio_windows, read_headers
from sonoframe.sources.listing import list_files, opened
from tests.test_sources import make_wave


def walked(root, suffix):
    found = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if not n.startswith((".", "_"))]
        found += [f"{folder}/{f}" for f in files if f.endswith(suffix) and not f.startswith((".", "_"))]
    return sorted(found)


def test_listing_equals_a_walk(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i in range(700):
        folder = tmp_path / "t" / "/".join(f"d {rng.integers(4)}é" for _ in range(rng.integers(0, 5)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{['', '_', '.'][i % 11 % 3] if i % 11 < 3 else ''}{i}%{['.wav', '.WAV', '.txt'][i % 3]}").write_bytes(b"x" * (i % 5))
    (tmp_path / "t" / "_hidden").mkdir()
    (tmp_path / "t" / "_hidden" / "a.wav").write_bytes(b"")
    (tmp_path / "t" / "empty").mkdir()
    root = str(tmp_path / "t")
    got = list_files(spark, root, ".wav").collect()
    assert sorted(r.path for r in got) == walked(root, ".wav")
    assert all(os.path.getsize(r.path) == r.size for r in got)
    assert list_files(spark, f"{root}/empty", ".wav").collect() == []
    named = [r.path for r in got[:2]] + [f"{root}/empty"]
    assert sorted(r.path for r in list_files(spark, named, ".wav").collect()) == sorted(named[:2])
    assert list_files(spark, f"file://{got[0].path}").first().path == got[0].path
    with pytest.raises(FileNotFoundError):
        list_files(spark, f"{root}/none")


def test_many_files_reach_tasks_only(spark, tmp_path):
    for d in range(20):
        (tmp_path / "m" / f"s{d}").mkdir(parents=True)
        for i in range(250):
            (tmp_path / "m" / f"s{d}" / f"{i}.wav").touch()
    assert list_files(spark, str(tmp_path / "m"), ".wav").agg(F.countDistinct("path")).first()[0] == 5_000


def test_a_link_that_leads_back_ends(spark, tmp_path, monkeypatch):
    from sonoframe.sources import listing

    monkeypatch.setattr(listing, "DEEPEST", 3)
    (tmp_path / "l" / "a").mkdir(parents=True)
    (tmp_path / "l" / "a" / "back").symlink_to(tmp_path / "l")
    with pytest.raises(RuntimeError):
        list_files(spark, str(tmp_path / "l"))


def test_other_schemes():
    system, inner, prefix = opened("file:/a/b")
    assert (inner, prefix) == ("/a/b", "")


def windows_of(df):
    return sorted((os.path.basename(r.path), r.win_idx, r.start, r.end, r.sampling_rate, tuple(r.samples)) for r in df.collect())


@pytest.mark.parametrize(("width", "target"), [(2, None), (1, 13), (4, 40)])
@pytest.mark.parametrize("cut", [(1.0, None), (1.5, 0.4), (0, None)])
def test_ranges_equal_whole_files(spark, tmp_path, width, target, cut):
    rng = np.random.default_rng(width)
    high = {1: 256, 2: 2**15, 4: 2**31}[width]
    for i, n in enumerate([0, 1, 7, 20, 21, 333]):
        shape = n if i % 2 else (n, 2)
        make_wave(tmp_path / "w" / f"{i}.wav", rng.integers(0 if width == 1 else -high, high, shape), rate=20, width=width)
    root = str(tmp_path / "w")
    got = read_audio_windows(spark, root, cut[0], cut[1], target, range_bytes=64)
    whole = audio._windows_of_whole_files(spark, [root], cut[0], cut[1], target, linear_resampler)
    assert windows_of(got) == windows_of(whole)
    assert len(windows_of(got)) >= 5


def test_one_recording_spreads_over_tasks(spark, tmp_path):
    make_wave(tmp_path / "a.wav", np.arange(4000), rate=10)
    df = read_audio_windows(spark, str(tmp_path / "a.wav"), 1.0, range_bytes=200)
    assert df.select(F.spark_partition_id()).distinct().count() > 3
    assert df.count() == 400


def test_a_file_of_3_gb_is_read_in_ranges(spark, tmp_path):
    """A sparse file: a header for 3 GB of two channels, silence, and a few samples at the end."""
    n = 3 * 2**30 // 8
    head = b"RIFF" + struct.pack("<I", 36 + 8 * n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 128000, 8, 32)
    with open(tmp_path / "big.wav", "wb") as f:
        f.write(head + b"data" + struct.pack("<I", 8 * n))
        f.truncate(44 + 8 * n)
        f.seek(44 + 8 * (n - 2))
        f.write(struct.pack("<4i", 2**30, 2**30, -(2**29), 0))
    header = read_headers(spark, str(tmp_path / "big.wav")).first()
    assert (header.n_frames, header.data_at, header.rate) == (n, 44, 16000)

    def loud():
        return lambda x, rate: {"text": f"{len(x)}:{x[x != 0].tolist()}" if x.any() else ""}

    heard = transcribe_files(spark, str(tmp_path / "big.wav"), loud, 600.0).first()
    last = (n - 1) // 9_600_000
    assert len(heard.chunks) == last + 1 and heard.text.strip() == f"{n - last * 9_600_000}:[0.5, -0.125]"


def test_headers_that_promise_too_much(spark, tmp_path):
    content = encode_wave(np.linspace(-1, 1, 50), 10)
    (tmp_path / "short.wav").write_bytes(content[:-21])
    assert [len(r.samples) for r in read_audio_windows(spark, str(tmp_path), 0).collect()] == [39]
    (tmp_path / "bad.wav").write_bytes(b"RIFF no")
    with pytest.raises(Exception, match="cannot decode"):
        read_audio_windows(spark, str(tmp_path), 0).collect()
    with pytest.raises(FileNotFoundError):
        read_audio_windows(spark, str(tmp_path / "none"), 0)


def test_written_waves(spark, tmp_path):
    rows = [("a/1.wav", [0.5, -1.0, 2.0]), ("a/b/2.wav", []), ("3.wav", [0.25] * 40)]
    write_waves(spark.createDataFrame(rows, "name string, samples array<float>"), str(tmp_path / "w"), 10)
    assert walked(str(tmp_path / "w"), "") == sorted(f"{tmp_path}/w/{name}" for name, _ in rows)
    heard = transcribe_files(spark, str(tmp_path / "w"), lambda: lambda x, rate: {"text": f"{len(x)}:{x.sum()}"}, 3.0, 10)
    got = {os.path.basename(r.path): r.text for r in heard.collect()}
    assert got == {"1.wav": f"3:{0.5 - 1 + np.float32(32767 / 32768)}", "3.wav": "30:7.5 10:2.5"}
