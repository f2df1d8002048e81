"""Chat formatting with shared prefixes.

Conversations are sorted by the hashes of their turns, first turn first, so those that share initial
turns are neighbours. A task walks its range of them as a depth-first traversal of their prefix tree and
writes each turn's tokens once; position ids count along the path from the root, and each turn has
the token intervals of its ancestors, which with its own earlier tokens are all it may attend to.
A range never depends on one turn: equal prefixes are cut by conversation, and a sequence ends at a
number of tokens or conversations, after which the shared turns are written again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import partitions_for

#: The template: a turn is OPEN role newline text CLOSE. These strings are escaped inside roles and texts.
OPEN, CLOSE = "<s>", "</s>"
CONTROLS = (CLOSE, OPEN, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
MAX_TOKENS = 16_384
MAX_CONVERSATIONS = 256
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*)", re.S)
_loaded: dict[str, object] = {}


def escape(text: str) -> str:
    """A backslash before backslashes and after the first character of control strings."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """The turn's head, body and end."""
    return OPEN + escape(role).replace("\n", "\\\n") + "\n", escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        m = _TURN.fullmatch(part)
        turns.append((unescape(m[1]), unescape(m[2])))
    return turns


def _encoding(path: str, pattern: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


SEQUENCE = (
    "sequence_id long, ids array<int>, position_ids array<int>, loss array<boolean>, "
    "turns array<struct<start: int, end: int, parent: int, loss_start: int, loss_end: int, sees: array<struct<start: int, end: int>>>>, "
    "conversations array<struct<conv_id: long, turn: int>>"
)


class _Sequence:
    """The tree under construction: one row of the result."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.turns: list[dict] = []
        self.depths: list[int] = []  # tokens from the root to the end of each turn
        self.path: list[int] = []
        self.said: list[tuple[str, str]] = []
        self.members: list[dict] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < len(turns) and n < len(self.said) and turns[n] == self.said[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], encode) -> None:
        n = self.shared(turns)
        del self.path[n:]
        self.said = list(turns)
        for role, text in turns[n:]:
            head, body, end = (encode(x) for x in format_turn(role, text))
            start, parent = len(self.ids), self.path[-1] if self.path else -1
            self.ids += [*head, *body, *end]
            merged: list[dict] = []
            if parent >= 0:  # what the parent sees, and the parent
                above = self.turns[parent]
                merged = list(above["sees"])
                if merged and merged[-1]["end"] == above["start"]:
                    merged[-1] = {"start": merged[-1]["start"], "end": above["end"]}
                else:
                    merged.append({"start": above["start"], "end": above["end"]})
            loss = (start + len(head), start + len(head) + len(body)) if role == "assistant" else (start, start)
            self.turns.append({"start": start, "end": len(self.ids), "parent": parent, "loss_start": loss[0], "loss_end": loss[1], "sees": merged})
            self.depths.append((self.depths[parent] if parent >= 0 else 0) + len(self.ids) - start)
            self.path.append(len(self.turns) - 1)
        self.members.append({"conv_id": conv_id, "turn": self.path[-1] if self.path else -1})

    def row(self) -> dict:
        position, loss = np.zeros(len(self.ids), np.int32), np.zeros(len(self.ids), bool)
        for t, depth in zip(self.turns, self.depths, strict=True):
            n = t["end"] - t["start"]
            position[t["start"] : t["end"]] = np.arange(depth - n, depth)
            loss[t["loss_start"] : t["loss_end"]] = True
        return {"sequence_id": self.members[0]["conv_id"], "ids": self.ids, "position_ids": position, "loss": loss, "turns": self.turns, "conversations": self.members}


def sequences(turns: DataFrame, vocabulary: str, pattern: str, max_tokens: int = MAX_TOKENS, max_conversations: int = MAX_CONVERSATIONS) -> DataFrame:
    """Prefix-shared sequences of all conversations in ``turns`` (conv_id, turn, role, text).

    Turns stand by turn, then role, then text; a null turn comes first, null roles and texts are
    empty. Repeated rows are turns of their own. Rows with null conv_id form one conversation.
    sequence_id is the first conversation's id. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    lean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = partitions_for(spark, lean.count(), 20_000)
    conv = lean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    order = F.transform("said", lambda t: F.xxhash64(t["role"], t["text"]))
    dealt = conv.withColumn("order", order).repartitionByRange(parts, "order", "conv_id").sortWithinPartitions("order", "conv_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        schema = None
        open_ = _Sequence()

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        interval = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        turn = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("sees", interval)])
        schema = pa.schema([
            ("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
            ("turns", pa.list_(turn)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("turn", pa.int32())]))),
        ])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for conv_id, said in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = [(t["role"], t["text"]) for t in said]
                    if open_.members and (not open_.shared(own) or len(open_.ids) >= max_tokens or len(open_.members) >= max_conversations):
                        rows.append(open_.row())
                        open_ = _Sequence()
                    open_.add(conv_id, own, encode)
                if rows:
                    yield out(rows)
        if open_.members:
            yield out([open_.row()])

    return dealt.select("conv_id", "said").mapInArrow(build, SEQUENCE)


def digests(made: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """What each conversation reads like in ``sequences``' result: digests of its turns and loss text."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, sequence_id long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary, pattern)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for r in range(batch.num_rows):
                seq, turns, members = (batch.column(i)[r].as_py() for i in (0, 3, 4))
                ids, loss = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in (1, 2))
                # Each turn is decoded once, however many conversations share it.
                spans = [slice(t["start"], t["end"]) for t in turns]
                raw = [enc.decode_bytes(ids[x].tolist()) for x in spans]
                learned = [unescape(enc.decode_bytes(ids[x][loss[x]].tolist()).decode()) if loss[x].any() else "" for x in spans]
                for m in members:
                    path, k = [], m["turn"]
                    while k >= 0:
                        path.append(k)
                        k = turns[k]["parent"]
                    path.reverse()
                    whole = b"".join([raw[k] for k in path]).decode()
                    said, text = parse(whole), "".join([learned[k] for k in path])
                    turn_bytes = "".join(f"{r}\n{t}\n" for r, t in said).encode()
                    values = (m["conv_id"], len(said), hashlib.sha256(turn_bytes).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest(), len(whole), seq)
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)

    return made.select("sequence_id", "ids", "loss", "turns", "conversations").mapInArrow(read, schema)
