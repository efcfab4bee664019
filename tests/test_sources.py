import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from sonoframe.plans.manifests import build_manifest, build_sentence_manifest, unmatched_report
from sonoframe.plans.prepare import prepare, read_custom, registry
from sonoframe.registry import CorpusRegistry
from sonoframe.sinks.tables import write_manifest_arrays, write_manifest_jsonl, write_processed, write_transcripts
from sonoframe.sources import json_records
from sonoframe.sources.audio import read_audio, read_audio_windows
from sonoframe.sources.corpora import list_waves, read_common_voice, read_processed, read_vivos_corpus, read_vivos_table
from sonoframe.sources.lines import read_prompts, read_sentences
from sonoframe.sources.manifests import manifest_keys, read_manifest, read_manifests


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def odd_text(n_lines):
    rng = np.random.default_rng(3)
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "\n\n", "\n 　\n"]
    words = ["xin", "chào", "đây", "là", " ", "một", " ", "câu"]
    out = []
    for i in range(n_lines):
        body = " ".join(rng.choice(words, rng.integers(0, 9)))
        out.append(body + breaks[rng.integers(len(breaks))])
    return "".join(out)


def test_sentences_literal(spark, tmp_path):
    f = tmp_path / "s.txt"
    f.write_text("﻿ a \nb\x0bc\n\n  　\nlast", encoding="utf-8")
    got = rows(read_sentences(spark, str(f)), "n", "text")
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, "last")]


def test_sentences_over_many_blocks(spark, tmp_path, small_blocks):
    f = tmp_path / "s.txt"
    text = odd_text(6000)
    f.write_bytes(text.encode("utf-8"))
    expected = [(i, s) for i, s in enumerate((x.strip() for x in text.splitlines() if x.strip()), 1)]
    sentences = read_sentences(spark, str(f))
    assert spark.read.text(str(f)).select(F.spark_partition_id()).distinct().count() > 3
    assert rows(sentences, "n", "text") == expected
    # Numbers come from a broadcast of block starts; the lines stay where they are.
    plan = sentences._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sentences_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_sentences(spark, str(tmp_path / "none.txt"))
    (tmp_path / "blank.txt").write_text(" \n\n")
    with pytest.raises(ValueError):
        read_sentences(spark, str(tmp_path / "blank.txt"))


def test_prompts(spark, tmp_path):
    f = tmp_path / "prompts.txt"
    f.write_text("A X Y\n\nB\nA   LAST \nC D one　two", encoding="utf-8")
    assert rows(read_prompts(spark, str(f)), "utt_id", "text") == [("A", "LAST"), ("D", "one　two")]
    with pytest.raises(FileNotFoundError):
        read_prompts(spark, str(tmp_path / "none.txt"))


def test_prompts_last_wins_over_many_blocks(spark, tmp_path, small_blocks):
    lines = [f"U{i % 97} text {i}" for i in range(4000)]
    f = tmp_path / "prompts.txt"
    f.write_text("\n".join(lines))
    want = {}
    for line in lines:
        key, text = line.split(None, 1)
        want[key] = text
    assert dict(rows(read_prompts(spark, str(f)), "utt_id", "text")) == want


RECORDS = [
    {"audio_filepath": "/a/1.wav", "text": "Xin } chào", "speaker_id": "s1"},
    {"audio_filepath": "/a/2.wav", "text": 'quote " ], [ {', "speaker_id": "s2"},
    {"audio_filepath": "/a/3.wav", "text": 'a"},{"b"}, {"c {{ }]', "speaker_id": None},
]


def dumped(records, layout):
    def dump(**how):
        return json.dumps(records, ensure_ascii=False, **how)

    return {
        "lines": "\n".join(json.dumps(r, ensure_ascii=False) for r in records) + "\n",
        "blank first": "\n \n" + "\n\n".join(json.dumps(r) for r in records),
        "indented": dump(indent=2),
        "crlf": dump(indent=2).replace("\n", "\r\n"),
        "bom": "\ufeff" + dump(indent=2),
        "one line": dump(),
        "compact": dump(separators=(",", ":")) + "\n",
        "compact bom": "\ufeff" + dump(),
        "indent four": dump(indent=4),
    }[layout]


LAYOUTS = ["lines", "blank first", "indented", "crlf", "bom", "one line", "compact", "compact bom", "indent four"]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_manifest_layouts_agree(spark, tmp_path, layout):
    f = tmp_path / "m.json"
    for n in (3, 1):
        f.write_bytes(dumped(RECORDS[:n], layout).encode("utf-8"))
        order = lambda rs: sorted(rs, key=str)
        assert order(tuple(r) for r in read_manifest(spark, str(f)).collect()) == order(tuple(r.values()) for r in RECORDS[:n])
        assert manifest_keys(spark, str(f)) == {"audio_filepath", "text", "speaker_id"}


@pytest.mark.parametrize("text", ["", "[]", "[\n]\n"])
def test_empty_manifests(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    assert read_manifest(spark, str(tmp_path / "m.json")).count() == 0


@pytest.mark.parametrize("layout", ["lines", "indented", "one line", "compact"])
def test_manifests_are_split_over_tasks(spark, tmp_path, small_blocks, layout):
    records = [{"audio_filepath": f"/a/{i}.wav", "text": 'câu { "} },{" số ' + "}" * (i % 5) + str(i)} for i in range(3000)]
    f = tmp_path / "m.json"
    f.write_text(dumped(records, layout), encoding="utf-8")
    df = read_manifest(spark, str(f))
    assert rows(df, "audio_filepath", "text") == sorted(tuple(r.values()) for r in records)
    # A few kilobytes would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


NESTED = T.StructType().add("id", "long").add("text", "string").add("meta", T.MapType(T.StringType(), T.StringType())).add(
    "words", T.ArrayType(T.StructType().add("w", "string").add("at", T.ArrayType(T.IntegerType())))
)


def nested_records(n, seed=1):
    rng = random.Random(seed)
    texts = [" }, {", '"', "\\", '\\"}]', "{{[[", "câu ]}", "", '", "id": 7}, {"id": 8', "\\" * 5, "\u2028 \n \t", "}" * 9]
    return [
        {
            "id": i, "text": "".join(rng.choice(texts) for _ in range(rng.randint(0, 6))),
            "meta": {rng.choice(texts): rng.choice(texts) for _ in range(rng.randint(0, 2))},
            "words": [{"w": rng.choice(texts), "at": [1, 2][: rng.randint(0, 2)]} for _ in range(rng.randint(0, 3))],
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("layout", [l for l in LAYOUTS if l != "blank first"] + ["joined"])
def test_nested_records_equal_the_json_module(spark, tmp_path, small_blocks, layout):
    records, ascii = nested_records(400), layout in ("compact", "indented")
    texts = "".join(json.dumps(r, ensure_ascii=ascii) for r in records) if layout == "joined" else dumped(records, layout)
    f = tmp_path / "m.json"
    f.write_bytes(texts.encode())
    got = json_records.json_objects(spark, str(f), chunk_bytes=300).collect()
    assert sorted((json.loads(r.value) for r in got), key=lambda r: r["id"]) == records
    if layout != "joined":  # the built-in reader takes one object a line
        parsed = read_manifest(spark, str(f), NESTED).collect()
        assert sorted((r.asDict(recursive=True) for r in parsed), key=lambda r: r["id"]) == records


def test_records_larger_than_chunks(spark, tmp_path):
    records = [{"id": i, "text": "x{" * n, "meta": {}, "words": [{"w": "}{", "at": [i]}] * 40} for i, n in enumerate([0, 5000, 1, 3])]
    f = tmp_path / "m.json"
    f.write_text(json.dumps(records))
    got = json_records.json_objects(spark, str(f), chunk_bytes=64).collect()
    assert sorted((json.loads(r.value) for r in got), key=lambda r: r["id"]) == records


def test_structure_is_the_same_from_every_cut(tmp_path):
    content = json.dumps(nested_records(12)).encode()
    whole = json_records.scan(np.frombuffer(content, np.uint8), json_records.OUTSIDE)
    assert whole.exit == json_records.OUTSIDE and whole.steps.sum() == 0
    for cut in range(1, len(content)):
        first = json_records.scan(np.frombuffer(content[:cut], np.uint8), json_records.OUTSIDE)
        second = json_records.scan(np.frombuffer(content[cut:], np.uint8), first.exit)
        assert np.array_equal(np.concatenate((first.places, second.places + cut)), whole.places)


def test_many_array_files_in_one_folder(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(60):
        record = {"audio_filepath": f"/a/{i}.wav", "text": " }, {", "speaker_id": "s"}
        layout = [json.dumps([record]), json.dumps([record], indent=2), json.dumps(record) + "\n", "[]", ""][i % 5]
        (folder / f"{i}.json").write_text(layout)
    got = rows(read_manifest(spark, str(folder)), "audio_filepath")
    assert got == sorted((f"/a/{i}.wav",) for i in range(60) if i % 5 < 3)


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "1}]', '[{"a": 1}]]', '[{"a": 1}, 7]', '[[{"a": 1}]]', '[{"a": 1}] x', '[{"a": 1}{]'])
def test_broken_arrays_fail(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(Exception):
        read_manifest(spark, str(tmp_path / "m.json"), T.StructType().add("a", "string")).collect()


def test_array_sink(spark, tmp_path):
    records = nested_records(50)
    df = spark.createDataFrame([tuple(r.values()) for r in records], NESTED).repartition(3)
    write_manifest_arrays(df, str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    assert sorted((r for f in files for r in json.loads(f.read_text())), key=lambda r: r["id"]) == records
    write_manifest_arrays(df.limit(0), str(tmp_path / "none"))
    assert read_manifest(spark, str(tmp_path / "none"), NESTED).count() == 0


def test_malformed_manifest_fails(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text('{"audio_filepath": "/a"}\n{broken\n')
    with pytest.raises(Exception):
        read_manifest(spark, str(f)).collect()


def test_manifest_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        read_manifests(spark, {})
    with pytest.raises(FileNotFoundError):
        read_manifests(spark, {"train": str(tmp_path / "none.json")})


def write_lines(path, records):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records), encoding="utf-8")
    return str(path)


def test_custom_corpus(spark, tmp_path):
    train = write_lines(tmp_path / "t", RECORDS[:2])
    dev = write_lines(tmp_path / "d", [{"audio_filepath": "/b/1.wav", "text": "X"}])
    df = read_custom(spark, {"train": train, "eval": dev})
    assert set(df.columns) == {"audio", "transcript", "speaker_id", "split"}
    assert rows(df, "split", "audio", "transcript") == [
        ("eval", "/b/1.wav", "x"),
        ("train", "/a/1.wav", "xin chào"),
        ("train", "/a/2.wav", "quote"),
    ]
    raw = read_custom(spark, {"train": train}, normalize=False)
    assert rows(raw, "transcript") == [("Xin } chào",), ('quote " ], [ {',)]
    with_rate = df.schema["audio"].metadata
    assert with_rate == {"sampling_rate": 16000}


def test_speaker_rename_is_all_or_none(spark, tmp_path):
    a = write_lines(tmp_path / "a", [{"audio_filepath": "1", "text": "x", "speaker": "p"}])
    b = write_lines(tmp_path / "b", [{"audio_filepath": "2", "text": "y"}])
    assert "speaker_id" not in read_custom(spark, {"train": a, "eval": b}, speaker_column="speaker").columns
    both = read_custom(spark, {"train": a, "eval": a}, speaker_column="speaker")
    assert rows(both, "speaker_id") == [("p",), ("p",)]


def make_wave(path, samples, rate=16000, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = np.asarray(samples)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1 if data.ndim == 1 else data.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data.astype({1: "u1", 2: "<i2", 4: "<i4"}[width]).tobytes())


@pytest.fixture
def corpus(tmp_path):
    for split in ("train", "test"):
        base = tmp_path / "c" / split
        for rel in ("SP1/A.wav", "SP2/A.wav", "SP1/Z.wav", "R.wav", "SP 1/x/a%b é.wav", "SP1/B.WAV"):
            make_wave(base / "waves" / rel, [0, 1])
        (base / "prompts.txt").write_text("A một hai\nR ba\nU unused\na%b đúng\nB big\n", encoding="utf-8")
    return tmp_path / "c"


def test_list_waves(spark, corpus):
    df = list_waves(spark, str(corpus / "train"))
    root = str((corpus / "train" / "waves").resolve())
    want = ["R.wav", "SP 1/x/a%b é.wav", "SP1/A.wav", "SP1/Z.wav", "SP2/A.wav"]
    assert [r[0] for r in rows(df, "audio")] == [f"{root}/{w}" for w in want]
    assert rows(df, "speaker_id", "utt_id") == [
        ("R.wav", "R"), ("SP 1", "a%b é"), ("SP1", "A"), ("SP1", "Z"), ("SP2", "A"),
    ]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "binaryFile" not in plan  # names are listed by tasks, nothing is opened
    with pytest.raises(FileNotFoundError):
        list_waves(spark, str(corpus))


def test_corpus_join(spark, corpus, tmp_path):
    df = read_vivos_corpus(spark, str(corpus))
    assert rows(df.filter("split = 'train'"), "speaker_id", "text") == [
        ("R.wav", "ba"), ("SP1", "một hai"), ("SP2", "một hai"),
    ]
    missing = unmatched_report(spark, str(corpus))
    assert rows(missing.filter("split = 'test'"), "utt_id") == [("Z",), ("a%b é",)]
    counts = build_manifest(spark, str(corpus), str(tmp_path / "out"))
    assert {(r["split"], r["n"]) for r in counts.collect()} == {("train", 3), ("test", 3), (None, 6)}
    back = read_manifests(spark, {"train": str(tmp_path / "out" / "split=train")})
    assert rows(back, "speaker_id", "text") == rows(df.filter("split = 'train'"), "speaker_id", "text")


def test_corpus_without_rows_fails(spark, tmp_path):
    make_wave(tmp_path / "c" / "train" / "waves" / "S" / "A.wav", [0])
    (tmp_path / "c" / "train" / "prompts.txt").write_text("B x\n")
    with pytest.raises(ValueError):
        build_manifest(spark, str(tmp_path / "c"), str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        read_vivos_corpus(spark, str(tmp_path / "nothing"))


def test_sentence_manifest_is_utf8_and_readable(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Chào\n\nhai ba\n", encoding="utf-8")
    out = build_sentence_manifest(spark, str(tmp_path / "s.txt"), str(tmp_path / "o"), "dev")
    assert rows(out, "audio_filepath", "text", "split") == [
        (f"{tmp_path}/o/dev/audio/utt_00001.wav", "Chào", "dev"),
        (f"{tmp_path}/o/dev/audio/utt_00002.wav", "hai ba", "dev"),
    ]
    raw = b"".join(p.read_bytes() for p in (tmp_path / "o" / "manifest").rglob("part-*.json"))
    assert "Chào".encode() in raw


def test_common_voice(spark, tmp_path):
    data = [
        ("train", "1.mp3", "  Xin, chào ", "c", 2, 0, "x"),
        ("train", "2.mp3", None, "c", 2, 0, "x"),
        ("train", "3.mp3", "", "c", 2, 0, "x"),
        ("train", "4.mp3", "  ", "c", 2, 0, "x"),
        ("test", "5.mp3", "T", "c", 2, 0, "x"),
        ("other", "6.mp3", "O", "c", 2, 0, "x"),
    ]
    df = spark.createDataFrame(
        data, "split string, audio string, sentence string, client_id string, up_votes int, down_votes int, age string"
    )
    df.write.partitionBy("split").parquet(str(tmp_path / "cv"))
    out = read_common_voice(spark, str(tmp_path / "cv"))
    assert rows(out, "split", "audio", "transcript") == [
        ("test", "5.mp3", "t"), ("train", "1.mp3", "xin chào"), ("train", "4.mp3", ""),
    ]
    assert set(out.columns) == {"audio", "transcript", "client_id", "up_votes", "down_votes", "split"}
    assert rows(read_common_voice(spark, str(tmp_path / "cv"), include_test_split=False), "split") == [("train",)] * 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [split" in plan.replace("isnotnull", "split") or "split#" in plan.split("PartitionFilters")[1]
    tsv = tmp_path / "train.tsv"
    tsv.write_text('path\tsentence\tclient_id\tup_votes\tdown_votes\n1.mp3\t"Xin" chào\tc\t3\t1\n', encoding="utf-8")
    got = read_common_voice(spark, {"train": str(tsv)}, fmt="csv", audio_column="path")
    assert rows(got, "audio", "transcript", "up_votes") == [("1.mp3", "xin chào", 3)]


def test_vivos_table_and_processed_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("train", "a", "X.", "s"), ("test", "b", "Y", "s"), ("2024", "c", "Z", "s")],
        "split string, audio string, sentence string, speaker_id string",
    )
    df.write.partitionBy("split").parquet(str(tmp_path / "v"))
    out = prepare(spark, "vivos", str(tmp_path / "p"), path=str(tmp_path / "v"), eval_split="2024")
    back = read_processed(spark, str(tmp_path / "p"))
    assert rows(back, "split", "audio", "transcript", "speaker_id") == rows(
        out, "split", "audio", "transcript", "speaker_id"
    ) == [("2024", "c", "z", "s"), ("train", "a", "x", "s")]
    assert back.schema["audio"].metadata == {"sampling_rate": 16000}
    raw = read_vivos_table(spark, str(tmp_path / "v"), normalize=False)
    assert rows(raw, "transcript") == [("X.",), ("Y",)]
    with pytest.raises(FileNotFoundError):
        read_processed(spark, str(tmp_path / "none"))
    df.drop("split").write.parquet(str(tmp_path / "flat"))
    with pytest.raises(TypeError):
        read_processed(spark, str(tmp_path / "flat"))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", "x\ny")], "split string, audio string, text string")
    write_processed(df, str(tmp_path / "p"))
    write_processed(df, str(tmp_path / "p"))
    assert read_processed(spark, str(tmp_path / "p")).count() == 1
    write_manifest_jsonl(df.filter("false"), str(tmp_path / "e"))
    assert not list((tmp_path / "e").rglob("part-*"))
    write_transcripts(df, str(tmp_path / "t"), text_only=True)
    assert rows(spark.read.text(str(tmp_path / "t"))) == [("x y",)]
    write_transcripts(df, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).columns == df.columns


def test_registry():
    r = CorpusRegistry()
    r.register("a", lambda spark, **k: (spark, k), "about a", {"language": "vi"})
    with pytest.raises(ValueError):
        r.register("a", None, "again")
    assert r.create("a", 1, x=2) == (1, {"x": 2})
    assert r.describe("a") == "about a" and r.metadata("a") == {"language": "vi"} and list(r.keys()) == ["a"]
    for call in (lambda: r.create("b", None), lambda: r.describe("b")):
        with pytest.raises(KeyError):
            call()
    assert list(registry.keys()) == ["vivos", "common_voice_vi", "custom"]


def test_read_audio(spark, tmp_path):
    mono = np.array([0, 16384, -32768, 32767])
    make_wave(tmp_path / "w" / "mono.wav", mono)
    make_wave(tmp_path / "w" / "stereo.wav", np.array([[0, 16384], [-16384, 0]]))
    make_wave(tmp_path / "w" / "bytes.wav", np.array([0, 128, 255]), width=1)
    make_wave(tmp_path / "w" / "wide.wav", np.array([1 << 30, -(1 << 31)]), width=4)
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_audio(spark, str(tmp_path / "w")).collect()}
    assert got["mono.wav"]["array"] == [0.0, 0.5, -1.0, np.float32(32767 / 32768)]
    assert got["stereo.wav"]["array"] == [0.25, -0.25]
    assert got["bytes.wav"]["array"] == [-1.0, 0.0, np.float32(127 / 128)]
    assert got["wide.wav"]["array"] == [0.5, -1.0]
    half = read_audio(spark, str(tmp_path / "w" / "mono.wav"), target_sr=8000).collect()[0]
    assert (half["sampling_rate"], half["n_samples"], half["array"]) == (8000, 2, [0.0, -1.0])
    with pytest.raises(FileNotFoundError):
        read_audio(spark, str(tmp_path / "none.wav"))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnope")
    with pytest.raises(Exception, match="bad.wav"):
        read_audio(spark, str(tmp_path / "bad.wav")).collect()
    # Asking for the path alone decodes nothing but still lists every file.
    assert read_audio(spark, str(tmp_path / "w")).count() == 4


def test_read_audio_windows(spark, tmp_path):
    make_wave(tmp_path / "w" / "a.wav", np.arange(25), rate=10)
    got = rows(read_audio_windows(spark, str(tmp_path / "w"), 1.0), "win_idx", "start", "end")
    assert got == [(0, 0, 10), (1, 10, 20), (2, 20, 25)]
    over = rows(read_audio_windows(spark, str(tmp_path / "w"), 1.0, 0.5), "win_idx", "start", "end")
    assert over == [(0, 0, 10), (1, 5, 15), (2, 10, 20), (3, 15, 25), (4, 20, 25)]
    assert rows(read_audio_windows(spark, str(tmp_path / "w"), 0), "start", "end") == [(0, 25)]


ARRAYS = {
    "one-per-line": '[\n  {"audio_filepath": "a", "text": "x"},\n  {"audio_filepath": "b", "text": "y"}\n]',
    "mixed": '[{"audio_filepath": "a", "text": "x"}, {"audio_filepath": "b", "text": "y"},{"audio_filepath": "c", "text": "z"}]',
    "braces": json.dumps([{"audio_filepath": "a", "text": "{" * 80}, {"audio_filepath": "b", "text": "x"}]),
    **{f"indent-{n}": json.dumps([{"audio_filepath": str(i), "text": "é {} ["} for i in range(5)], indent=n) for n in (1, 2, 4)},
    "one": '[{"audio_filepath": "a", "text": "x"}]',
    "none": "[]",
}


@pytest.mark.parametrize("name", ARRAYS)
def test_no_array_loses_a_row(spark, tmp_path, name):
    path = tmp_path / "m.json"
    path.write_text(ARRAYS[name])
    expected = [(r["audio_filepath"], r["text"]) for r in json.loads(ARRAYS[name])]
    found = read_manifest(spark, str(path)).select("audio_filepath", "text").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_text_like_a_separator_never_loses_a_row(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"audio_filepath": "a", "text": "x"}, {"audio_filepath": "b", "text": "ends in }, {"}, {"audio_filepath": "c", "text": "z"}]))
    try:
        assert read_manifest(spark, str(path)).count() == 3 and len(read_manifest(spark, str(path)).collect()) == 3
    except Exception as error:
        assert "MALFORMED" in str(error)


def test_folder_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text(ARRAYS["mixed"])
    (tmp_path / "b.json").write_text('{"audio_filepath": "d", "text": "w"}\n{"audio_filepath": "e", "text": "v"}\n')
    assert {r["audio_filepath"] for r in read_manifest(spark, str(tmp_path)).collect()} == set("abcde")


def test_numbers_survive_another_split_size(spark, tmp_path):
    from sonoframe.sources.lines import read_sentences

    path = tmp_path / "s.txt"
    path.write_text("".join(f"sentence {i}\n" for i in range(1, 3001)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        numbered = read_sentences(spark, str(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = {r["n"]: r["text"] for r in numbered.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows == {i: f"sentence {i}" for i in range(1, 3001)}


def test_every_named_recording_is_read(spark, tmp_path):
    import wave

    from sonoframe.sources.audio import read_audio

    for name in ("a.wav", "b.dat"):
        with wave.open(str(tmp_path / name), "wb") as out:
            out.setparams((1, 2, 16000, 0, "NONE", ""))
            out.writeframes(b"\0\0" * 8)
    assert read_audio(spark, [str(tmp_path / "a.wav"), str(tmp_path / "b.dat")]).count() == 2
    assert read_audio(spark, str(tmp_path / "b.dat")).count() == 1
    assert read_audio(spark, str(tmp_path)).count() == 1


def test_split_names_stay_as_they_are(spark, tmp_path):
    table = spark.createDataFrame([("train", "a.wav", "x"), ("01", "b.wav", "y"), ("2", "c.wav", "z")], "split string, audio string, sentence string")
    table.write.partitionBy("split").parquet(str(tmp_path / "t"))
    numbers = table.filter("split <> 'train'")
    numbers.write.partitionBy("split").parquet(str(tmp_path / "n"))
    assert rows(read_vivos_table(spark, str(tmp_path / "n"), "01", "2"), "split", "audio") == [("01", "b.wav"), ("2", "c.wav")]
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"
