"""Shared helpers: whole-text word hashing on bytes, bounded slices of Arrow batches, tables cut from lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a pattern for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker expands into arrays at a time (one longer document is its own slice).
SLICE_BYTES = 2_000_000

_MASK = (1 << 64) - 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_BYTE_KEYS = np.random.default_rng(20240917).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i modulo 2**64 (or its inverse's powers) for i < n; kept and doubled when too short."""
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        got, size = np.ones(1, np.uint64), 1
        while size < n:
            got = np.concatenate([got, got * np.uint64(pow(b, size, 1 << 64))])
            size *= 2
        if size <= 1 << 23:
            _powers[base, inverse] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """The words of some texts: byte spans in data, 64-bit hashes, and the first word of each text and the byte where it
    begins (both with one more at the end)."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    begins: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: list[bytes]) -> Words:
    """Every maximal run of bytes outside SPACES, for all texts at once."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    space = IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_KEYS[raw] * powers(_BYTE_BASE, len(raw)), dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * powers(_BYTE_BASE, len(raw), True)[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, begins), begins)


def windows_of(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of so many words fits into its text, and the windows' 64-bit hashes."""
    n = len(hashes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_WORD_BASE, n), dtype=np.uint64)])
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + size <= ends)
    return at, mix((sums[at + size] - sums[at]) * powers(_WORD_BASE, max(n, 1), True)[at])


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of n words a window of that size at one of these positions covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + size, n), -1)
    return np.cumsum(steps[:-1]) > 0


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string or binary column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together; a longer text makes a range of its own."""
    lo, held = 0, 0
    for i, x in enumerate(texts):
        size = len(x or b"") + 1
        if i > lo and held + size > limit:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(texts):
        yield lo, len(texts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (a single machine)."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="docspring-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


_open: list[list[Scratch]] = []


@contextmanager
def collected() -> Iterator[list[Scratch]]:
    """All scratches that are made inside, so that their tables can go when what reads them has been written."""
    held: list[Scratch] = []
    _open.append(held)
    try:
        yield held
    finally:
        _open.remove(held)


class Scratch:
    """Tables that one call of an operator writes to the shared folder and reads back: that cuts the lineage, and outlives
    executors. What the call's result doesn't read is deleted at the call's end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []
        for held in _open:
            held.append(self)

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/docspring/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but these."""
        for df, path in self.tables:
            if not any(df is k for k in keep):
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.tables = [t for t in self.tables if any(t[0] is k for k in keep)]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back, for as long as the folder lasts."""
    return Scratch(df.sparkSession).stored(df, label)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work for mapInArrow; at its end the worker, which Spark keeps for other tasks, returns free memory to the system."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(column) -> object:
    """A to Z lower-cased, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
