"""Byte-level BPE (8): prefix dynamic programming. For each byte prefix of a piece the one last token that its encoding
can end with is stored; an append extends the table, an edit makes it anew until its entries are the old ones again."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docspring.llm.common import as_bytes, slices

#: Fixed value: the White_Space characters of Unicode, as the rank files' own library reads \s.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks, pieces and token pairs that a Python worker keeps of each kind, and the characters of a chunk or piece at most.
KEPT, LONG = 400_000, 64


def plain_pattern(pattern: str) -> str:
    """The split pattern with \\s and \\S spelt out, since Python counts U+001C to U+001F among them."""
    return pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


class PrefixTable:
    """The encoding of one byte string that grows and changes. last[i] is the last token of the encoding of the first i bytes."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Entries of shorter prefixes stay as they are."""
        self.data += more
        self._fill([])

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Bytes start to end become new. Prefixes up to start keep their entries; behind the edit, entries are made anew until
        as many as the longest token has bytes are what they were, and so are all that follow. Returns how many were made."""
        before = self.last[end + 1 :]
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :]
        return self._fill(before)

    def _fill(self, before: list[int]) -> int:
        """before: the entries that the last prefixes had."""
        last, sizes, pairs, longest = self.last, self.codec.sizes, self.codec.pairs, self.codec.longest
        want = begin = len(last)
        tail, agreed = len(self.data) + 1 - len(before), 0
        for at, token in self.codec.automaton.iter(self.data.decode("latin-1"), max(0, begin - longest)):
            if at + 1 != want:
                if at + 1 < want:
                    continue
                break
            start = want - sizes[token]
            if pairs[last[start], token] if start else self.codec.splits[token] is not False:
                last.append(token)
                if want >= tail:
                    agreed = agreed + 1 if before[want - tail] == token else 0
                    if agreed == longest:
                        last += before[want - tail + 1 :]
                        return want + 1 - begin
                want += 1
        if want <= len(self.data):
            raise ValueError(f"byte {self.data[want - 1]} is not in the vocabulary")
        return want - begin

    def ids(self) -> list[int]:
        out, end, tokens = [], len(self.data), self.codec.tokens
        while end:
            out.append(self.last[end])
            end -= len(tokens[out[-1]])
        return out[::-1]


class Splits(dict):
    """token -> the two tokens that its last merge joins; None for a single byte, False if merges don't lead to it."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, token: int):
        data, ranks = self.codec.tokens[token], self.codec.ranks
        parts, got = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            rank, at = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=(None, 0))
            if rank is None:
                break
            if len(parts) == 2:
                got = ranks[parts[0]], ranks[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self[token] = got = got if len(parts) == 1 else False
        return got


class Pairs(dict):
    """(left, right) -> whether the merges leave exactly these two tokens of their joined bytes: going back through the merges
    that make them, the latest first, no merge across the boundary would have come earlier."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= 4 * KEPT:
            self.clear()
        self[pair] = got = self.stay(*pair)
        return got

    def stay(self, left: int, right: int) -> bool:
        tokens, ranks, splits = self.codec.tokens, self.codec.ranks, self.codec.splits
        a, b = splits[left], splits[right]
        if a is False or b is False:
            return False
        limit = len(ranks) + max(left, right)
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
                a = splits[left]
            else:  # of equal merges the leftmost comes first: the one across the boundary
                limit, right = right + 1, b[0]
                b = splits[right]


class Pieces(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        one = self.codec.ranks.get(raw)
        got = [one] if one is not None else PrefixTable(self.codec, raw).ids()
        if len(piece) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = got
        return got


class Chunks(dict):
    """What stands between two single spaces -> ids as text, each after a comma; None where white space may join another's."""

    def __init__(self, codec: Codec, first: bool):
        super().__init__()
        self.codec, self.first = codec, first

    def __missing__(self, chunk: str) -> str | None:
        word = chunk[1:] if chunk.startswith("\n") and not self.first else chunk
        if not word or word.split() != [word]:
            got = None
        else:
            whole = word if self.first else chunk if word is not chunk else " " + word
            got = "".join(f",{i}" for i in self.codec.encode_plain(whole))
        if len(chunk) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = got
        return got


class Codec:
    """Encoder and decoder over a rank file: each match of the split pattern by itself."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.sizes = [0] * (max(self.tokens) + 1)
        self.automaton = ahocorasick.Automaton()  # finds all tokens that end at a byte
        for b, i in self.ranks.items():
            self.sizes[i] = len(b)
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(plain_pattern(pattern)).findall
        self.splits, self.pairs, self.pieces = Splits(self), Pairs(self), Pieces(self)
        self.head, self.rest = Chunks(self, True), Chunks(self, False)

    def encode_plain(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.pieces[piece]]

    def encode_joined(self, text: str) -> str:
        """Ids in decimal, joined by commas."""
        if not text:
            return ""
        head, *rest = text.replace("\n", " \n").split(" ")
        try:
            return (self.head[head] + "".join(map(self.rest.__getitem__, rest)))[1:]
        except TypeError:
            return ",".join(map(str, self.encode_plain(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, vocabulary file and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) and the digests of both, for each row; every text is encoded whole.

    A null text counts as empty: no ids. Rows are independent; repeated rows give repeated results, an empty table none,
    and other columns are ignored.
    """
    schema = "doc_id long, ids array<int>, ids_sha256 string, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        table: list = [b""] * (max(c.tokens) + 1)
        for i, b in c.tokens.items():
            table[i] = b
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                joined = [c.encode_joined((x or b"").decode()) for x in texts[lo:hi]]
                ids = [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x in joined]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[lo:hi], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                        pa.array([b"".join(map(table.__getitem__, x.tolist())) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "ids", "ids_sha256", "decoded"],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
