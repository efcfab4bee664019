"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: all conversations are sorted by the chain
of their turns, so each one's shared turns are those it has in common with the one before it. Only
the others are emitted, which writes the tree depth first. A sequence holds one stretch of that
order; every turn in it is a node with its token span, its position (the tokens before it in its own
conversation, not in the sequence) and the spans of its ancestors, which are all it may attend to
besides itself. Sequences are bounded: when one is full, the next begins with the whole path again.

Template: ``<s>role[INST]text</s>`` for each turn; the loss mask covers the text of ``assistant`` turns. Inside
roles and texts a backslash is doubled, and a control string gets one after its first character,
so no control string is left in them and the original comes back.

Defined results: a null role or text is empty; turns sort by turn (nulls first), role and text, and
repeated rows are turns of their own; rows without a conversation id form one conversation; an
empty table gives an empty table. A conversation is one value and must fit in one.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sonoframe.llm.tokens import ranks, token_ids

SEQUENCE_TOKENS = 1 << 16
SEQUENCE_CONVERSATIONS = 4096  # that end in one sequence
SEQUENCE_BITS = 36
LOSS_ROLE = "assistant"

BEGIN, MIDDLE, END = "<s>", "[INST]", "</s>"
CONTROLS = (BEGIN, MIDDLE, END, "[/INST]")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)</s>", re.DOTALL)

PATHS = "conv_id bigint, path array<bigint>, roles array<string>, texts array<string>"
SPAN = "struct<start: bigint, length: bigint>"
NODE = f"struct<start: bigint, length: bigint, position: bigint, parent: int, loss: {SPAN}, ancestors: array<{SPAN}>>"
SEQUENCES = (
    f"sequence_id bigint, ids array<int>, position_ids array<int>, nodes array<{NODE}>,"
    " conversations array<struct<conv_id: bigint, node: int>>"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def conversation_paths(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``(conv_id, turn, role, text)``: its turns, and for each a hash of
    the chain up to it."""
    schema = _arrow(PATHS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain, held = None, [], []  # current: a conversation's id in a tuple

        def finished() -> tuple:
            path, state = [], b""
            for role, text in chain:
                state = hashlib.blake2b(
                    state + len(role.encode()).to_bytes(8, "little") + role.encode() + text.encode(), digest_size=8
                ).digest()
                path.append(int.from_bytes(state, "little", signed=True))
            return current[0], path, [r for r, _ in chain], [t for _, t in chain]

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
            for conv_id, role, text in rows:
                if current != (conv_id,):
                    if current is not None:
                        held.append(finished())
                    current, chain = (conv_id,), []
                chain.append((role, text))
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema
                )
                held = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(finished(), schema, strict=True)], schema=schema)

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(gather, PATHS)


class _Sequence:
    """One sequence under construction."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.length = 0
        self.nodes: list[dict] = []
        self.stack: list[tuple[tuple[str, str], int]] = []  # turns of the last path and their nodes
        self.conversations: list[dict] = []

    def add(self, conv_id, turns: list[tuple[str, str]], segments: dict[str, np.ndarray]) -> None:
        shared = 0
        while shared < min(len(self.stack), len(turns)) and self.stack[shared][0] == turns[shared]:
            shared += 1
        del self.stack[shared:]
        for role, text in turns[shared:]:
            head, body, tail = segments[f"{BEGIN}{escape(role)}{MIDDLE}"], segments[escape(text)], segments[END]
            parent = self.stack[-1][1] if self.stack else -1
            above = self.nodes[parent] if self.stack else None
            spans = [dict(s) for s in above["ancestors"]] if above else []
            if above and spans and spans[-1]["start"] + spans[-1]["length"] == above["start"]:
                spans[-1]["length"] += above["length"]
            elif above:
                spans.append({"start": above["start"], "length": above["length"]})
            length = len(head) + len(body) + len(tail)
            loss = {"start": self.length + len(head), "length": len(body) if role == LOSS_ROLE else 0}
            self.stack.append(((role, text), len(self.nodes)))
            self.nodes.append(
                {
                    "start": self.length, "length": length, "parent": parent, "loss": loss, "ancestors": spans,
                    "position": above["position"] + above["length"] if above else 0,
                }
            )
            self.ids += [head, body, tail]
            self.length += length
        self.conversations.append({"conv_id": conv_id, "node": self.stack[-1][1]})

    def row(self, sequence_id: int, schema: pa.Schema) -> pa.RecordBatch:
        positions = np.concatenate([n["position"] + np.arange(n["length"]) for n in self.nodes])
        values = [sequence_id, np.concatenate(self.ids), positions.astype(np.int32), self.nodes, self.conversations]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def prefix_sequences(
    turns: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, sequence_conversations: int = SEQUENCE_CONVERSATIONS
) -> DataFrame:
    """The sequences of all conversations. Conversations are sorted over the whole cluster by their
    chains and then their ids, so a first turn, or a conversation, that a third of them share is spread
    over tasks."""
    schema = _arrow(SEQUENCES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sequence, base = 0, _Sequence(), TaskContext.get().partitionId() << SEQUENCE_BITS
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts")), strict=True))
            heads = {f"{BEGIN}{escape(r)}{MIDDLE}" for _, roles, _ in rows for r in roles}
            strings = [*({escape(t) for _, _, texts in rows for t in texts} | heads | {END})]
            segments = dict(zip(strings, token_ids(pa.array(strings, pa.string())), strict=True))
            for conv_id, roles, texts in rows:
                sequence.add(conv_id, list(zip(roles, texts, strict=True)), segments)
                if sequence.length >= sequence_tokens or len(sequence.conversations) >= sequence_conversations:
                    yield sequence.row(base + made, schema)
                    made, sequence = made + 1, _Sequence()
        if sequence.conversations:
            yield sequence.row(base + made, schema)

    paths = conversation_paths(turns).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return paths.mapInArrow(build, SEQUENCES)


def read_back(sequences: DataFrame) -> DataFrame:
    """Every conversation's digests, from nothing but token ids, spans and ancestors."""
    schema = _arrow(DIGESTS)

    def digest(ids: np.ndarray, nodes: list[dict], node: int) -> tuple:
        decode = ranks().decode_bytes
        spans = [*nodes[node]["ancestors"], {"start": nodes[node]["start"], "length": nodes[node]["length"]}]
        whole = b"".join(decode(ids[s["start"] : s["start"] + s["length"]].tolist()) for s in spans).decode()
        turns = [(unescape(r), unescape(t)) for r, t in TURN.findall(whole)]
        path = []
        while node >= 0:
            path.append(nodes[node]["loss"])
            node = nodes[node]["parent"]
        masked = [unescape(decode(ids[s["start"] : s["start"] + s["length"]].tolist()).decode()) for s in reversed(path) if s["length"]]
        loss = "".join(masked)
        listed = "".join(f"{r}\n{t}\n" for r, t in turns)
        return (
            len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), len(whole),
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy()
                nodes, known, rows = batch.column("nodes")[i].as_py(), {}, []
                for end in batch.column("conversations")[i].as_py():
                    node = end["node"]
                    if node not in known:
                        known[node] = digest(ids, nodes, node)
                    rows.append((end["conv_id"], *known[node]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

    return sequences.mapInArrow(read, DIGESTS)
