import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sonoframe.llm import structure
from sonoframe.llm.queries import QUERIES

NEXT = {(None, "s"): "s", (None, "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain(rows):
    """A conversation's (turn, role, text) rows in order: all columns of the summary, by comparing whole audits."""
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not visible:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append(None if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    states, never = [None, "s", "u", "a"], (10**9, "~", [])
    best = {s: (0, "", []) if s in (None, "a") else never for s in states}

    def insertions():
        for _ in range(3):
            for s in states:
                for to in "ua":
                    if (s, to) in NEXT:
                        cost, audit, made = best[NEXT[s, to]]
                        best[s] = min(best[s], (cost + 2, "I" + audit, [{"u": "user:", "a": "assistant:"}[to], *made]))

    insertions()
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        after, best = best, {}
        for s in states:
            ways = [(after[s][0] + 3, "D" + after[s][1], after[s][2])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (s, role[:1]) in NEXT:
                    cost, audit, made = after[NEXT[s, role[:1]]]
                    ways.append((cost + more, "K" + audit, [f"{role}:{text}", *made]))
                for full in ("user", "assistant"):
                    if (s, full[0]) in NEXT:
                        cost, audit, made = after[NEXT[s, full[0]]]
                        ways.append((cost + 2 + more, "R" + audit, [f"{full}:{text}", *made]))
            best[s] = min(ways)
        insertions()
    cost, audit, made = best[None]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:], strict=False)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


def in_order(rows, conv):
    def key(row):
        turn, role, text = row
        told = f"{'-' if conv is None else conv}:{'-' if turn is None else turn}:{hashlib.sha256(text.encode()).hexdigest()}:{role}"
        return turn is not None, turn or 0, role, text[:64], hashlib.sha256(told.encode()).digest()[:16]

    return sorted(rows, key=key)


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "Done!  ", "So. it", "Long " * 30 + "a.", "Long " * 30 + "b"]
    out = {}
    for conv in range(n):
        rows = []
        for turn in range(rng.choice([0, 1, 2, 5, 9, 30])):
            turn = rng.choice([turn, turn, turn, None, turn * 2])
            text = rng.choice(texts) if rng.random() < 0.6 else f"Say {rng.randint(0, 10**6)}."
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u2"])
            rows += [(turn, role, text)] * rng.choice([1, 1, 1, 2, 7])
        out[conv] = rows
    return out


@pytest.mark.parametrize("piece_rows", [3, 4096])
def test_repair_equals_the_plain_form(spark, piece_rows):
    given = conversations(5, 150)
    rows = [(c, t, r, x, 1) for c, part in given.items() for t, r, x in part] + [(c, None, None, None, 0) for c in given]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    edits = structure.repaired(turns, F.col("n"), piece_rows=piece_rows, hot_rows=20)
    got = {r[0]: tuple(r)[1:] for r in structure.summary(edits).collect()}
    assert got == {c: plain(in_order(part, c)) for c, part in given.items()}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (2, 0, "assistant", "Hm")]
    edits = structure.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    listed = [(r.conv_id, r.edit, r.fault, r.new_role, r.text) for r in edits.orderBy("conv_id", "place").collect()]
    assert listed == [
        (1, "K", None, "user", "Hi."), (1, "D", "duplicate", None, None), (1, "R", None, "assistant", "Well?"),
        (2, "D", "truncated", None, None),
    ]


def test_long_conversation_in_many_pieces(spark):
    """One conversation that is cut into many pieces, over partitions, and a run of equal rows."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Say {t}.", f"Say {t}", "Again."])) for t in range(3000)]
    rows += [(7, 5000, "user", "Same.")] * 500 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in structure.summary(structure.repaired(turns, piece_rows=64, hot_rows=100)).collect()}
    assert got == {c: plain(in_order([r[1:] for r in rows if r[0] == c], c)) for c in (7, 8)}


def test_runs_by_powers_equal_single_steps():
    rng = random.Random(3)
    marks = ["s", "u", "a", "?", "s!", "u!", "a!", "?!", structure.GONE]
    for _ in range(200):
        runs = [(rng.choice(marks), rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        single = [(m, 1) for m, n in runs for _ in range(n)]
        end = structure.TO_PAY_AT_END
        assert structure.product(runs) == structure.product(single)
        assert structure.edits_of(runs, structure.NOTHING, end) == structure.edits_of(single, structure.NOTHING, end)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, place int, EDIT string"
    rows = [(None, None, None, None, 1, "x"), (None, 3, "user", None, 1, "x"), (4, 1, None, "Hi.", None, None)]
    turns = spark.createDataFrame(rows, schema)
    got = {r[0]: tuple(r)[1:] for r in structure.summary(structure.repaired(turns)).collect()}
    assert got == {None: plain([(None, " ", " "), (3, "user", " ")]), 4: plain([(1, " ", "Hi.")])}
    assert structure.summary(structure.repaired(turns.limit(0))).collect() == []


def test_query_equals_the_plain_form(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = [(10**6, t, "user", None) for t in range(8)] + [(10**6 + 1 + k, 0, "user", "Only this") for k in range(60)] + [(None, None, None, "A.")]
    real.unionByName(spark.createDataFrame(extra, real.schema)).write.parquet(f"{tmp_path}/conversations.parquet")
    given = {}
    for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect():
        name = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        role, text, fate = r.role or " ", r.text if r.text is not None else " ", zlib.crc32(name.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        row = (r.turn, "user" if fate == 4 else role, text)
        given.setdefault(r.conv_id, []).extend([] if fate == 0 else [row, row] if fate == 3 else [row])
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_structure"].build(spark, str(tmp_path)).collect()}
    assert got == {c: plain(in_order(part, c)) for c, part in given.items()}
    assert ("", hashlib.sha256(b"").hexdigest()) in {g[-2:] for g in got.values()}
