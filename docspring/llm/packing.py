"""Packing (6): best-fit decreasing over token counts, with a segment tree over open windows by remaining capacity."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docspring.llm.common import as_bytes, trimmed

WINDOW = 2048
END_ID = 1
#: The emptiest windows are cut up only into gaps of at least so many tokens.
LEAST_CUT = 64
#: Tokens that one task packs together before it writes its windows.
GROUP_TOKENS = 4_000_000
#: Words whose ids a Python worker keeps, and their characters at most.
KEPT_WORDS, LONG = 400_000, 64

#: Fixed value: the pattern by which byte-level vocabularies of this kind split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"


class BestFit:
    """Open windows by remaining capacity. leaf c of the tree counts the windows with c tokens left; the tightest window
    that takes a piece of n tokens is the first occupied leaf at or after n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}
        self.window, self.count = window, 0

    def _add(self, leaf: int, by: int) -> None:
        node = leaf + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def _first(self, least: int) -> int | None:
        """The smallest occupied capacity of at least so many tokens."""
        node = least + self.size
        if self.tree[node]:
            return least
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None

    def put(self, n: int) -> tuple[int, int]:
        """The window for a piece of n tokens and the offset in it."""
        room = self._first(n)
        if room is None:
            which, room = self.count, self.window
            self.count += 1
        else:
            which = self.open[room].pop()
            self._add(room, -1)
        left = room - n
        if left:
            self.open.setdefault(left, []).append(which)
            self._add(left, 1)
        return which, self.window - room


def cut(n_tokens: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of full windows from the front, then the rest."""
    full = n_tokens // window * window
    return [(s, window) for s in range(0, full, window)] + ([(full, n_tokens - full)] if n_tokens > full else [])


def pack(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int, int]]]:
    """For each document (start, length, window, offset) of its pieces. Longest pieces first, ties by document and start.
    While the gaps of the other windows can take what the emptiest holds, it is cut up and dealt out to them."""
    pieces = sorted((-length, doc, start) for doc, n in enumerate(lengths) for start, length in cut(n, window))
    fit, held, fills = BestFit(window), [], []
    for minus, doc, start in pieces:
        which, offset = fit.put(-minus)
        if which == len(held):
            held.append([])
            fills.append(0)
        held[which].append((doc, start, -minus, offset))
        fills[which] -= minus
    gaps = sorted((w for w in range(len(held)) if window - fills[w] >= LEAST_CUT), key=lambda w: fills[w])
    room = sum(window - fills[w] for w in gaps)
    while gaps and room - (window - fills[gaps[0]]) >= fills[gaps[0]]:
        emptiest, at = gaps.pop(0), 0
        room -= window
        for doc, start, length, _ in held[emptiest]:
            while length:
                if fills[gaps[at]] == window:
                    at += 1
                part = min(length, window - fills[gaps[at]])
                held[gaps[at]].append((doc, start, part, fills[gaps[at]]))
                fills[gaps[at]] += part
                start, length = start + part, length - part
        held[emptiest] = []
        gaps = sorted((w for w in gaps if window - fills[w] >= LEAST_CUT), key=lambda w: fills[w])
        room = sum(window - fills[w] for w in gaps)
    placed: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for which, rows in enumerate(x for x in held if x):
        for doc, start, length, offset in rows:
            placed[doc].append((start, length, which, offset))
    for x in placed:
        x.sort()
    return placed


def byte_of_symbol() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one after U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_table(tokenizer) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary whose ids are in the order of its merges."""
    table = byte_of_symbol()
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(map(table.__getitem__, token)): i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token not in added}


def is_plain(path: str) -> bool:
    """Whether the tokenizer's file says what the leaner engine assumes: no normaliser, a byte-level splitter of this pattern
    without a space in front, merges in the order of their ids, and no exceptions from them."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, splitter = file["model"], file.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [vocab.get("".join(m), -1) for m in merges]
    return (
        model.get("type", "BPE") == "BPE"
        and file.get("normalizer") is None
        and splitter.get("type") == "ByteLevel"
        and not splitter.get("add_prefix_space", True)
        and splitter.get("use_regex", True)
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(a < b for a, b in zip([-1, *made[:-1]], made, strict=True))
        and len(set(vocab) - {"".join(m) for m in merges}) == 256 + len({t["content"] for t in file.get("added_tokens", [])} & set(vocab))
        and set(byte_of_symbol()) <= set(vocab)
        and all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and t["content"].split() == [t["content"]] for t in file.get("added_tokens", []))
    )


class WordIds(dict):
    """Chunk -> its ids as little-endian bytes. A chunk is what stands between two single spaces, with "\n" in front where
    a line begins; the split pattern always cuts there. Chunks with other white space or one of the tokenizer's added tokens give None:
    their text is encoded whole.
    At most KEPT_WORDS chunks of at most LONG characters are kept."""

    def __init__(self, encode, added: list[str], first: bool = False):
        super().__init__()
        self.encode, self.added, self.first = encode, added, first

    def __missing__(self, chunk: str) -> bytes | None:
        word = chunk[1:] if chunk.startswith("\n") and not self.first else chunk
        if not word or word.split() != [word] or any(a in chunk for a in self.added):
            got = None
        else:
            got = array("I", self.encode(word if self.first else chunk if word is not chunk else " " + word)).tobytes()
        if len(chunk) <= LONG:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[chunk] = got
        return got


class Encoder:
    """Ids of whole texts, the same as the tokenizer's for the whole text. If its file is as is_plain() says, new words go
    through its merge table in a leaner engine; texts whose white space may join words, and all texts of other files, go
    through the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.head = self.rest = None
        if is_plain(path):
            words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=merge_table(self.tokenizer), special_tokens={}).encode_ordinary
            added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.head, self.rest = WordIds(words, added, first=True), WordIds(words, added)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.rest is not None:
            head, *rest = text.replace("\n", " \n").split(" ")
            try:
                return self.head[head] + b"".join(map(self.rest.__getitem__, rest))
            except TypeError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, each in one sequence of at most `window` tokens.

    A null text counts as empty: such a document is its end id alone. Texts are encoded whole. Each task packs the
    documents that it reads, some `group_tokens` at a time, so nothing is shuffled and memory doesn't grow with the table;
    sequence ids are the task's number times 2**40 plus a counter, the same again if a task is repeated. A sequence is
    padded to `window`, unless its length is a power of two. Repeated rows are packed each; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        docs_held: list[tuple[int | None, bytes]] = []
        held = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs_held, held, made
            placed = pack([len(b) // 4 for _, b in docs_held], window)
            used: dict[int, int] = {}
            for x in placed:
                for _, length, which, _ in x:
                    used[which] = used.get(which, 0) + length
            rows = [(i, s, n, b[4 * s : 4 * (s + n)], len(b) // 4, base + made + w, o, used[w] if used[w] & (used[w] - 1) == 0 else window) for (i, b), x in zip(docs_held, placed, strict=True) for s, n, w, o in x]
            made += len(used)
            docs_held, held = [], 0
            for lo in range(0, len(rows), 4096):
                cols = list(zip(*rows[lo : lo + 4096], strict=True))
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = encode((raw or b"").decode()) + end
                docs_held.append((i, ids))
                held += len(ids) // 4
                if held >= group_tokens:
                    yield from flush()
        if docs_held:
            yield from flush()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)
