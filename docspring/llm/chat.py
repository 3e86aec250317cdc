"""Chat formatting (2): token-level assembly. The segments of a turn are encoded by themselves and reserved ids are spliced
in between; masks are prefix sums of openings and closings; control strings inside texts are escaped reversibly."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docspring.llm.common import as_bytes, partitions, slices

#: The template's control strings, in the order of their reserved ids. A turn is [TURN], its role, [SAYS], its text, [END];
#: the three common roles have an opening of their own. Those that follow belong to other templates, and are escaped too.
OPENINGS = {"user": "[INST]", "assistant": "<|answer|>", "system": "<<SYS>>"}
TURN, SAYS, END = "[TURN]", "[SAYS]", "</s>"
CONTROLS = [*OPENINGS.values(), TURN, SAYS, END]
FOREIGN = ["[/INST]", "<</SYS>>", "<s>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
LEARNED = "assistant"

_BARE = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS + FOREIGN))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS + FOREIGN))


def escape(text: str) -> str:
    """One more backslash after the first character of each control string (with any number of them there already)."""
    return _BARE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


class Template:
    """Encoder of turns, and the reader of what it made."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = max(ranks.values()) + 2
        self.ids = {c: self.base + i for i, c in enumerate(CONTROLS)}
        self.names = {i: c for c, i in self.ids.items()}
        self.roles = {self.ids[c]: role for role, c in OPENINGS.items()}
        self.codec = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.ids)

    def segment(self, text: str) -> list[int]:
        return self.codec.encode_ordinary(escape(text))

    def turn(self, role: str, text: str) -> list[int]:
        head = [self.ids[OPENINGS[role]]] if role in OPENINGS else [self.ids[TURN], *self.segment(role), self.ids[SAYS]]
        return [*head, *self.segment(text), self.ids[END]]

    def mask(self, ids: np.ndarray) -> np.ndarray:
        """What the loss covers: from after an answer's opening up to its end, by a running sum of +1 and -1."""
        opened, ended = ids == self.ids[OPENINGS[LEARNED]], ids == self.ids[END]
        reserved = np.cumsum(ids >= self.base)
        # an end closes an answer if the reserved id before it is an answer's opening
        last = np.concatenate([[-1], ids[ids >= self.base]])
        closes = ended & (last[np.maximum(reserved - 1, 0)] == self.ids[OPENINGS[LEARNED]])
        running = np.cumsum(opened.astype(np.int8) - closes.astype(np.int8))
        return (running - opened + closes) > 0

    def text(self, ids: list[int]) -> str:
        return self.codec.decode_bytes(ids).decode()

    def read(self, ids: list[int]) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn."""
        role, held = "", []
        for i in ids:
            if i < self.base:
                held.append(i)
                continue
            what = self.names[i]
            if what == SAYS:
                role = unescape(self.text(held))
            elif what == END:
                yield role, unescape(self.text(held))
            else:
                role = self.roles.get(i, "")
            held = []


_templates: dict[tuple[str, str], Template] = {}


def template(path: str, pattern: str) -> Template:
    if (path, pattern) not in _templates:
        _templates[path, pattern] = Template(path, pattern)
    return _templates[path, pattern]


def format_turns(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row for each row of turns (conv_id, turn, role, text): conv_id, turn, role, ids, loss_mask and formatted (their text).

    A conversation's rows in the order of turn (null first), then role and text, put together are its sequence. Null roles
    and texts count as empty. Each row is encoded by itself, however long a conversation is, and some megabytes of rows at a time.
    Repeated rows are turns of their own; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(vocabulary, pattern)
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in slices(as_bytes(whole.column(3)))):
            ids = [np.array(t.turn(role or "", text or ""), np.int32) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            made = [[x.tobytes() for x in ids], [t.mask(x).astype(np.uint8).tobytes() for x in ids], [t.text(x.tolist()) for x in ids]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary()), pa.array(made[2], pa.string())], names=["conv_id", "turn", "role", "text", "ids", "loss_mask", "formatted"])

    plain = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text"))
    return plain.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, loss_mask binary, formatted string")


def read_back(formatted: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row for each conversation, from ids and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Rows stream by in order; digests are all that is held of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, state = template(vocabulary, pattern), None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for conv, raw, mask in zip(*(batch[k].to_pylist() for k in ("conv_id", "ids", "loss_mask")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, np.int32)
                for role, text in t.read(ids.tolist()):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                learned = ids[np.frombuffer(mask, np.uint8).astype(bool) & (ids < t.base)]
                text = unescape(t.text(learned.tolist()))
                state[3] += len(text)
                state[4].update(text.encode())
                state[5] += len(t.text(ids.tolist()))
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([row(state)])

    ordered = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
