"""Substring dedup (1): level-wise doubling. Windows of words are hashed at a base length; those that occur once are gone,
and what is repeated is extended to twice that length, until the asked length is reached or no candidate survives.

At the base level a window is represented by the least of its base-length hashes (the same wherever the window stands), so
about one position in ten is sent. At later levels every surviving candidate is sent. Hashes are dealt out by value, never
collected; repeats within one slice of documents are merged before they are sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspring.llm.common import SLICE_BYTES, Scratch, Words, as_bytes, covered, mix, partitions, powers, slices, trimmed, words_of

WINDOW = 35
#: Parts that hashes and documents are dealt out to, at least; more if the session has more shuffle partitions. A task holds
#: one at a time.
PARTS = 256
#: Hashes that a worker holds before it sends them.
OUTBOX = 1_000_000
#: Kinds of the rows that travel: hashes to be compared, places found repeated, and documents.
HASHES, PLACES, TEXTS = 0, 1, 2
ROWS = "part int, kind int, keys binary, docs binary, at binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def pack_places(docs: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """Documents and word numbers, sorted by both: runs of documents with their lengths, and steps between the numbers."""
    begins = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    runs = np.stack([docs[begins], np.diff(np.concatenate([begins, [len(docs)]]))]) if len(docs) else np.zeros((2, 0), np.int64)
    return packed(runs.astype(np.int64)), packed(np.diff(at, prepend=0).astype(np.int32))


def unpack_places(docs: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    runs = unpacked(docs, np.int64).reshape(2, -1)
    return np.repeat(runs[0], runs[1]), np.cumsum(unpacked(at, np.int32))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def hashes_at(words: Words, size: int) -> np.ndarray:
    """The hash of the window of so many words at each position, as far as the words of all texts go."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * powers(base, n), dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * powers(base, n, True)[: n - size + 1])


def window_starts(words: Words, size: int) -> np.ndarray:
    """Positions at which a window lies within one text."""
    ends = np.repeat(words.first[1:], np.diff(words.first))
    return np.flatnonzero(np.arange(len(words.hashes)) + size <= ends)


def least_in(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each position that of the least hash among `width` from there on; of equal ones the first."""
    value, at, step = hashes, np.arange(len(hashes)), 1
    spans = [(value, at, 1)]
    while 2 * step <= width:
        keep = value[:-step] <= value[step:]
        value, at = np.where(keep, value[:-step], value[step:]), np.where(keep, at[:-step], at[step:])
        step *= 2
        spans.append((value, at, step))
    rest = width - step
    if not rest:
        return at
    keep = value[: len(value) - rest] <= value[rest:]
    return np.where(keep, at[: len(at) - rest], at[rest:])


def base_positions(words: Words, window: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, for each the position whose base-length hash represents it, and the base-length hashes."""
    hashes = hashes_at(words, base)
    starts = window_starts(words, window)
    if not len(starts):
        return starts, starts, hashes
    return starts, least_in(hashes, window - base + 1)[starts], hashes


def sent(keys: np.ndarray, docs: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows for these hashes and their places (sorted by place). Places of hashes that occur twice here are already known to
    be repeated; of those one stands for all among the hashes."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    twice = ~new | ~np.concatenate([new[1:], [True]])
    known = np.sort(order[twice])
    if len(known):
        yield from places_by_doc(docs[known], at[known], parts)
    first = np.sort(order[new])
    part = (keys[first] % np.uint64(parts)).astype(np.int32)
    order = first[np.argsort(part, kind="stable")]
    part.sort()
    edges = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        rows = order[lo:hi]
        yield int(part[edges[k]]), HASHES, np.ascontiguousarray(keys[rows]).tobytes(), *pack_places(docs[rows], at[rows])


def places_by_doc(docs: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows for places (sorted by document), in the part of their document."""
    part = (docs.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part.sort()
    edges = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[lo]), PLACES, b"", *pack_places(docs[order[lo:hi]], at[order[lo:hi]])


def by_part(rows: DataFrame, make, schema) -> DataFrame:
    """make() gives, for each task, work(part, rows of the part: kind, keys, docs, at, in the order of their kinds), which is
    called for one part after the other, and finish(), which is called at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, finish = make()
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for part, of_part in groupby(flat, key=lambda r: r[0]):
            yield from work(part, (r[1:] for r in of_part))
        yield from finish()

    dealt = rows.repartition(partitions(rows.sparkSession), "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(trimmed(run), schema)


def compare(rows: DataFrame, parts: int) -> DataFrame:
    """The places (rows of kind PLACES) of all hashes that occur twice or more."""

    def make():
        found: list[tuple[np.ndarray, np.ndarray]] = []  # places of several parts go together, so that there are fewer rows

        def work(part: int, of_part: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            keys, docs, at = [], [], []
            for kind, k, d, a in of_part:
                if kind == PLACES:
                    yield batch_of([(part, kind, k, d, a)])
                else:
                    keys.append(np.frombuffer(k, np.uint64))
                    x, y = unpack_places(d, a)
                    docs.append(x)
                    at.append(y.astype(np.int32))
            if keys:
                k, d, a = np.concatenate(keys), np.concatenate(docs), np.concatenate(at)
                keys, docs, at = [], [], []
                order = np.argsort(k)
                same = k[order][1:] == k[order][:-1]
                twice = np.zeros(len(k), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                if twice.any():
                    found.append((d[twice], a[twice]))
                if sum(len(x) for x, _ in found) >= OUTBOX:
                    yield from finish()

        def finish() -> Iterator[pa.RecordBatch]:
            if found:
                d, a = (np.concatenate(x) for x in zip(*found, strict=True))
                found.clear()
                order = np.lexsort((a, d))
                out = list(places_by_doc(d[order], a[order], parts))
                for lo in range(0, len(out), 64):
                    yield batch_of(out[lo : lo + 64])

        return work, finish

    return by_part(rows, make, ROWS)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about SLICE_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Outbox:
    """Hashes and places of several slices, sent together: fewer rows, and more repeats merged before they travel."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, keys: np.ndarray, docs: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, docs, at))
        self.size += len(keys)
        if self.size >= OUTBOX:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            rows = list(sent(*(np.concatenate(x) for x in zip(*self.held, strict=True)), self.parts))
            self.held, self.size = [], 0
            yield batch_of(rows)


def by_document(texts: DataFrame, places: DataFrame, parts: int, work, schema) -> DataFrame:
    """work(documents as a record batch, their words, flags of the words that a place points at, outbox) for slices of
    documents that meet their places; at a task's end work(None, None, None, outbox)."""

    def make():
        out = Outbox(parts)

        def of_a_part(part: int, of_part: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            docs, at = [], []
            places: tuple[np.ndarray, np.ndarray] | None = None

            def blobs() -> Iterator[pa.RecordBatch]:
                """The part's documents; its places come before them."""
                nonlocal places
                for kind, k, d, a in of_part:
                    if kind == PLACES:
                        x, y = unpack_places(d, a)
                        docs.append(x)
                        at.append(y.astype(np.int32))
                        continue
                    if places is None:
                        d, a = np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.int32), *at])
                        order = np.argsort(d, kind="stable")
                        places = d[order], a[order]
                        docs.clear()
                        at.clear()
                    yield from pa.ipc.open_stream(k)

            for held in merged(blobs()):
                d, a = places
                texts = [x or b"" for x in as_bytes(held["__text"])]
                for lo, hi in slices(texts):
                    words = words_of(texts[lo:hi])
                    names = held["__row"][lo:hi].to_numpy(zero_copy_only=False)
                    left, right = np.searchsorted(d, names), np.searchsorted(d, names, "right")
                    flags = np.zeros(len(words.hashes), bool)
                    for k in np.flatnonzero(right > left).tolist():
                        flags[words.first[k] + a[left[k] : right[k]]] = True
                    yield from work(held.slice(lo, hi - lo), words, flags, out)

        return of_a_part, lambda: work(None, None, None, out)

    return by_part(texts.unionByName(places), make, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, base: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with every word taken out of its text that a repeated window of `window` words covers, and the columns __words,
    __removed and __kept_words (the kept words, joined by one space).

    A window is repeated if its sequence of words starts at another place too, in any document or the same one; all its
    places lose their words. Windows are judged on the input. Texts that lose nothing stay byte for byte; elsewhere a kept
    word takes along the white space before it. A null text has no words and stays null. Repeated rows are documents of their
    own, so their windows repeat each other; texts shorter than a window lose nothing. An empty table gives no rows. Texts
    of any length are taken whole; one text's words and hashes must fit into a worker (some 60 bytes for each of its bytes).
    Other columns, whatever their names, are kept, but those of the names that are added, which are replaced. Windows go by
    64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = min(base or math.ceil(window / 2), window)
    parts = max(PARTS, partitions(spark))

    def named(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
        return batch["__row"][lo:hi].to_numpy(zero_copy_only=False)

    def send_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(parts)
        for batch in batches:
            texts = [x or b"" for x in as_bytes(batch["__text"])]
            for lo, hi in slices(texts):
                words, row = words_of(texts[lo:hi]), named(batch, lo, hi)
                _, least, hashes = base_positions(words, window, base)
                at = np.unique(least)
                text = np.searchsorted(words.first, at, "right") - 1
                yield from out.add(hashes[at], row[text], at - words.first[text])
        yield from out.flush()

    def send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            part = (named(batch, 0, batch.num_rows).view(np.uint64) % np.uint64(parts)).astype(np.int64)
            out = []
            for p in np.unique(part).tolist():
                some = batch.take(pa.array(np.flatnonzero(part == p)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=options) as writer:
                    writer.write_batch(some)
                out.append((p, TEXTS, sink.getvalue().to_pybytes(), b"", b""))
            yield batch_of(out)

    def extend(size: int, last: int):
        def work(batch: pa.RecordBatch | None, words: Words | None, flags: np.ndarray | None, out: Outbox) -> Iterator[pa.RecordBatch]:
            if batch is None:
                yield from out.flush()
                return
            if last == base:
                starts, least, _ = base_positions(words, window, base)
                # windows of this size within the asked windows whose representative is repeated
                inside = covered(len(flags), starts[flags[least]], window - size + 1) if len(starts) else flags
                at = np.flatnonzero(inside)
            else:
                at = window_starts(words, size)
                at = at[flags[at] & flags[at + size - last]]
            text = np.searchsorted(words.first, at, "right") - 1
            yield from out.add(hashes_at(words, size)[at], named(batch, 0, batch.num_rows)[text], at - words.first[text])

        return work

    fields = [f for f in docs.schema.fields if f.name not in ("__words", "__removed", "__kept_words")]
    n = [f.name for f in fields].index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if k == n else f.dataType) for k, f in enumerate(fields)] + [T.StructField("__words", T.LongType()), T.StructField("__removed", T.LongType()), T.StructField("__kept_words", T.StringType())])

    def cut(batch: pa.RecordBatch | None, words: Words | None, flags: np.ndarray | None, _: Outbox) -> Iterator[pa.RecordBatch]:
        if batch is None:
            return
        gone = covered(len(flags), np.flatnonzero(flags), window) if len(flags) else flags
        texts, kept_words, removed = [], [], []
        previous = np.concatenate([np.zeros(1, words.ends.dtype), words.ends[:-1]])
        for k, text in enumerate(as_bytes(batch["__text"])):
            lo, hi = int(words.first[k]), int(words.first[k + 1])
            lost = gone[lo:hi]
            kept = np.flatnonzero(~lost) + lo
            removed.append(int(lost.sum()))
            kept_words.append(b" ".join([words.data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)]))
            if removed[-1]:
                before = np.maximum(previous[kept], words.begins[k]).tolist()
                text = b"".join([words.data[b:e] for b, e in zip(before, words.ends[kept].tolist(), strict=True)]).lstrip()
            texts.append(text)
        arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if k == n else batch[f"c{k}"] for k in range(len(fields))]
        counts = np.diff(words.first).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept_words, pa.binary()).cast(pa.string())], names=schema.names)

    text = docs[text_col].cast("string")
    rows = docs.select(*(docs[f.name].alias(f"c{k}") for k, f in enumerate(fields) if k != n), text.alias("__text"), row_name(docs, id_col, text).alias("__row"))
    texts = rows.mapInArrow(trimmed(send_texts), ROWS)
    places = scratch.stored(compare(rows.select("__text", "__row").mapInArrow(trimmed(send_base), ROWS), parts), "level")
    size = base
    while size < window and not places.isEmpty():
        last, size = size, min(2 * size, window)
        places = scratch.stored(compare(by_document(texts, places, parts, extend(size, last), ROWS), parts), "level")
    scratch.drop(places)
    return by_document(texts, places, parts, cut, schema)


def row_name(docs: DataFrame, id_col: str, text: Column) -> Column:
    """A row's 64-bit name: equal rows share it. Of n rows about n * n / 2**65 pairs would share one by chance; those rows
    are found, and get another."""
    shared: list[int] = []
    names = docs.select(docs[id_col].alias("i"), text.alias("t"))
    names = names.select("i", "t", F.xxhash64("i", "t").alias("first"), F.xxhash64(F.lit("other"), "t", "i").alias("other"))

    def name(i: Column, t: Column, first: Column, salt: int) -> Column:
        return F.when(first.isin(shared), F.xxhash64(F.lit(salt), t, i)).otherwise(first) if shared else first

    for salt in range(100):
        of = names.select(name(F.col("i"), F.col("t"), F.col("first"), salt).alias("name"), "first", "other")
        found = of.groupBy("name").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y")
        more = [k for r in found.select("lo", "hi").limit(10_000).collect() for k in (r.lo, r.hi)]
        if not more:
            return name(docs[id_col], text, F.xxhash64(docs[id_col], text), salt)
        shared = sorted({*shared, *more})
    raise ValueError("rows can't be told apart")
