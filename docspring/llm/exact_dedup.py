"""Exact dedup (4): a log-structured merge index of digests. Memtables flush sorted runs with Bloom filters, compaction
merges the runs of a digest range, rows probe the filters of the compacted runs, and texts that hit a digest are compared
byte by byte with the one that stays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspring.llm.common import Scratch, as_bytes, lower_ascii, partitions, trimmed

#: Digests that a memtable holds before it is flushed.
MEMTABLE = 200_000
#: Digest ranges, each with its own tree of runs, at least and at most (powers of two), and the rows of a range between them.
RANGES, MOST_RANGES, ROWS_A_RANGE = 256, 1 << 16, 1_000_000
#: Bits of the filters over the compacted runs of all ranges together, which are sent to every task: a longer index's filters
#: let more pass, and rows are only moved in vain.
FILTER_BITS = 1 << 26
#: Copies of one text that are compared in one task; larger groups are dealt out to several.
COPIES_A_TASK = 64


def ranges_for(rows: int) -> int:
    return min(MOST_RANGES, max(RANGES, 1 << (-(-rows // ROWS_A_RANGE) - 1).bit_length()))


def range_of(digests: np.ndarray, ranges: int = RANGES) -> np.ndarray:
    """The range of each digest of 16 bytes, by its first two."""
    first = np.frombuffer(digests.tobytes(), ">u2")[::8].astype(np.int64)
    return first * ranges >> 16


class Filter:
    """A Bloom filter over digests of 16 bytes, about ten bits for each and `most` at most (powers of two)."""

    def __init__(self, digests: np.ndarray, most: int = 1 << 62):
        self.bits = min(max(64, 1 << (10 * len(digests)).bit_length()), max(64, most))
        held = np.zeros(self.bits, bool)
        for at in self._places(digests):
            held[at] = True
        self.packed = np.packbits(held, bitorder="little")

    @classmethod
    def of(cls, packed: bytes) -> Filter:
        out = cls.__new__(cls)
        out.packed, out.bits = np.frombuffer(packed, np.uint8), 8 * len(packed)
        return out

    def _places(self, digests: np.ndarray) -> list[np.ndarray]:
        a, b = np.frombuffer(digests.tobytes(), np.uint64).reshape(-1, 2).T
        return [(a + np.uint64(k) * b) & np.uint64(self.bits - 1) for k in range(4)]

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        """False: certainly not in here."""
        return np.logical_and.reduce([(self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0 for at in self._places(digests)])


class Run:
    """Sorted digests of 16 bytes, with the identifier that stays and the number of rows of each, and their filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.digests, self.ids, self.counts = digests, ids, counts

    @cached_property
    def filter(self) -> Filter:
        """Made when the run is probed: a run that is only merged needs none."""
        return Filter(self.digests)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Where each digest stands in this run, -1 if nowhere; only what passes the filter is searched."""
        out = np.full(len(digests), -1)
        if len(self.digests):
            (maybe,) = np.nonzero(self.filter.may_hold(digests))
            at = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
            out[maybe] = np.where(self.digests[at] == digests[maybe], at, -1)
        return out


def compact(runs: list[Run], largest: bool) -> Run:
    """One run of the digests of all; of equal ones the smallest identifier stays (the largest if asked), counts add up."""
    digests, ids, counts = (np.concatenate([getattr(r, k) for r in runs]) for k in ("digests", "ids", "counts"))
    order = np.argsort(digests, kind="stable")
    digests, ids, counts = digests[order], ids[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]]))
    return Run(digests[begins], (np.maximum if largest else np.minimum).reduceat(ids, begins), np.add.reduceat(counts, begins))


class Index:
    """Memtable and levels of runs. A level of `fan` runs is compacted into one of the next."""

    def __init__(self, largest: bool = False, memtable: int = MEMTABLE, fan: int = 4):
        self.largest, self.limit, self.fan = largest, memtable, fan
        self.memtable: dict[bytes, list[int]] = {}
        self.levels: list[list[Run]] = []

    def add(self, digest: bytes, identifier: int, count: int = 1) -> None:
        held = self.memtable.get(digest)
        if held is None:
            if len(self.memtable) >= self.limit:
                self.flush()
            self.memtable[digest] = [identifier, count]
        else:
            held[0] = max(held[0], identifier) if self.largest else min(held[0], identifier)
            held[1] += count

    def flush(self) -> None:
        if self.memtable:
            digests, held = np.array(list(self.memtable), "S16"), np.array(list(self.memtable.values()), np.int64)
            order = np.argsort(digests, kind="stable")
            self.add_run(Run(digests[order], held[order, 0], held[order, 1]))
            self.memtable = {}

    def add_run(self, run: Run, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            self.add_run(compact(runs, self.largest), level + 1)

    def runs(self) -> list[Run]:
        self.flush()
        return [r for level in self.levels for r in level]

    def compacted(self) -> Run | None:
        runs = self.runs()
        return compact(runs, self.largest) if runs else None


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def exact_dedup(docs: DataFrame, keep: str = "min", digest: Callable[[bytes], bytes] = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if identical after lower-casing A to Z only; a null text counts as empty. Of equal texts the row with
    the smallest doc_id stays (keep="max": the largest). A null doc_id stays only where no other row has that text.
    Repeated rows each count in group_size, and rows that share the id that stays are all kept. Other columns are ignored;
    an empty table gives no rows.

    digest maps the normalised text to at least 16 bytes; the first 16 are its address in the index. Texts at the address
    of the one that stays are compared with it whole, and where an address turns out to hold different texts its rows are
    grouped again by the texts themselves.
    """
    spark, largest, scratch = docs.sparkSession, keep == "max", Scratch(docs.sparkSession)

    def flush_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(largest)
        none = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                index.add(digest((x or b"").lower())[:16], none if i is None else i)
        for run in index.runs():
            part = range_of(run.digests, ranges)
            edges = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
            cuts = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(part[lo]) for lo, _ in cuts], pa.int32())} | {k: pa.array([x[lo:hi].tobytes() for lo, hi in cuts], pa.binary()) for k, x in (("digests", run.digests), ("ids", run.ids), ("counts", run.counts))})

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range its filter, and the digests that two rows or more have; one range after the other."""
        none = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for part, rows in groupby(flat, key=lambda r: r[0]):
            index = Index(largest)
            for _, digests, ids, counts in rows:
                index.add_run(Run(np.frombuffer(digests, "S16"), np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)))
            run = index.compacted()
            (more,) = np.nonzero(run.counts > 1)
            ids, raw = run.ids[more], run.digests[more].tobytes()
            columns = [pa.array([raw[k : k + 16] for k in range(0, len(raw), 16)], pa.binary()), pa.array(ids, pa.int64(), mask=ids == none), pa.array(run.counts[more], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(more), pa.int32()), pa.nulls(len(more), pa.binary()), *columns], names=names)
            packed = Filter(run.digests[more], FILTER_BITS // ranges).packed.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary()), *(pa.nulls(1, c.type) for c in columns)], names=names)

    def addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {part: Filter.of(packed) for part, packed in filters.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            lowered = [(x or b"").lower() for x in as_bytes(batch.column(1))]
            full = [digest(x) for x in lowered]
            sha = full if digest is sha256 else map(sha256, lowered)
            digests = np.frombuffer(b"".join(x[:16] for x in full), "S16")
            part, maybe = range_of(digests, ranges), np.zeros(len(full), bool)
            for p in np.unique(part).tolist():
                if p in probes:
                    (at,) = np.nonzero(part == p)
                    maybe[at] = probes[p].may_hold(digests[at])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": batch.column(1), "address": pa.array([x[:16] for x in full], pa.binary()), "text_sha256": [x.hex() for x in sha], "maybe": pa.array(maybe)})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [(a or b"").lower() == (b or b"").lower() for a, b in zip(as_bytes(batch["text"]), as_bytes(batch["keep_text"]), strict=True)]
            yield pa.RecordBatch.from_pydict({k: batch[k] for k in ("doc_id", "address", "text_sha256", "keep_id", "group_size")} | {"same": pa.array(same, pa.bool_())})

    names = ["part", "filter", "address", "keep_id", "group_size"]
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ranges = ranges_for(docs.count())
    runs = plain.mapInArrow(trimmed(flush_runs), "part int, digests binary, ids binary, counts binary")
    index = scratch.stored(runs.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(trimmed(merge_runs), "part int, filter binary, address binary, keep_id long, group_size long"), "index")
    filters = {r.part: bytes(r.filter) for r in index.where("filter is not null").select("part", "filter").collect()}  # FILTER_BITS / 8 bytes at most, in as many parts as there are ranges
    groups = index.where("address is not null").select("address", "keep_id", "group_size")
    rows = plain.mapInArrow(trimmed(addressed), "doc_id long, text string, address binary, text_sha256 string, maybe boolean")
    # the same join at every size; only rows that pass a filter are moved
    probed = scratch.stored(rows.where("maybe").drop("maybe").join(groups.hint("merge"), "address", "left"), "probed")
    copies = probed.where("group_size is not null")

    # each copy meets the text that stays in one of size / COPIES_A_TASK places, so that no group lands in one task
    salts = F.greatest(F.lit(1), F.ceil(F.col("group_size") / COPIES_A_TASK)).cast("int")
    stays = copies.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("address").agg(F.min("text").alias("keep_text"), F.max("group_size").alias("group_size"))
    stays = stays.select("address", "keep_text", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    checked = scratch.stored(salted.join(stays.hint("merge"), ["address", "salt"]).mapInArrow(trimmed(compared), "doc_id long, address binary, text_sha256 string, keep_id long, group_size long, same boolean"), "checked")
    nothing_else = rows.where(~F.col("maybe")).unionByName(probed.where("group_size is null").select("doc_id", "text", "address", "text_sha256", F.lit(False).alias("maybe")))

    columns = ("doc_id", "keep_id", "group_size", "text_sha256")
    single = nothing_else.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    shared = checked.where(~F.col("same")).select("address").distinct()
    scratch.drop(probed, checked)
    if shared.isEmpty():
        out = single.unionByName(checked.select(*columns))
    else:
        whole = copies.join(shared, "address", "left_semi").select("doc_id", "text_sha256", lower_ascii(F.coalesce("text", F.lit(""))).alias("normal"))
        best = (F.max if largest else F.min)("doc_id").alias("keep_id")
        again = whole.join(whole.groupBy("normal").agg(best, F.count(F.lit(1)).alias("group_size")), "normal").select(*columns)
        out = single.unionByName(checked.join(shared, "address", "left_anti").select(*columns)).unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
