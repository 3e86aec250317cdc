"""Exact nearest vectors from cells around pivots: rings of a cell that the triangle inequality excludes aren't read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import vectors
from docspring.staging import Staging

#: Vectors that pivots are chosen from, pivots at most, and rounds of moving them to their cells' means.
SAMPLE, PIVOTS, ROUNDS = 4096, 64, 6
#: Vectors of a ring at most: one row of the table.
RING = 1024
#: Rings that each query reads first, and what rounding may take from a bound.
SEEDS, SLACK = 2, 1e-7
#: Queries that go through the table at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Cells:
    """rings: ring, cell, n, lo and hi (distances from the cell's pivot), ids, matrix (float64, one vector after the other). With
    the cosine, distances are those of vectors of length 1; vectors without a length are in cell -1, which bounds nothing."""

    rings: DataFrame
    pivots: np.ndarray
    metric: str

    @property
    def size(self) -> int:
        return self.pivots.shape[1]


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which of them had no length."""
    n = np.linalg.norm(x, axis=1)
    tiny = n < vectors.TINY
    return x / np.where(tiny, 1.0, n)[:, None], tiny


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row of x from each pivot."""
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0.0))


def rows_of(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def chosen_pivots(vecs: DataFrame, metric: str, most: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Means of a bounded sample's clusters, from rows that lie far from each other. They decide how much is read, not what is
    found."""
    got = [r.v for r in vecs.select(F.col("v"), F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()]
    if not got:
        return np.zeros((1, 1))
    x = np.array(got, np.float64)
    if metric == "cosine":
        x, tiny = unit(x)
        x = x[~tiny] if not tiny.all() else x[:1]
    first, near = [0], distances(x, x[:1])[:, 0]
    while len(first) < min(most, max(1, int(len(x) ** 0.5))) and near.max() > 0:
        first.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[first[-1:]])[:, 0])
    pivots = x[first].copy()
    for _ in range(ROUNDS):
        of = distances(x, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            if (of == p).any():
                pivots[p] = x[of == p].mean(axis=0)
    return pivots


def build(vecs: DataFrame, path: str, metric: str = "l2", id_col: str = "chunk_pos", vector: str = "embedding", pivots: int = PIVOTS, ring: int = RING) -> Cells:
    """The cells of vecs, written under this path. Null vectors take no part; another dimension than the first is an error."""
    plain = vecs.select(F.col(id_col).cast("long").alias("id"), vectors.doubles(vector).alias("v")).where("v is not null")
    centers = chosen_pivots(plain, metric, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(1), batch.num_rows)
            if x.shape[1] != centers.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} dimensions, cells of {centers.shape[1]}")
            u, tiny = unit(x) if metric == "cosine" else (x, np.zeros(len(x), bool))
            d = distances(u, centers)
            cell = d.argmin(axis=1)
            # from the difference, so that a bound is as exact as what it bounds
            far = np.linalg.norm(u - centers[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(tiny, -1, cell).astype(np.int32)), pa.array(np.where(tiny, 0.0, far))], names=["id", "v", "cell", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n, at = 0, None

        def made() -> pa.RecordBatch:
            ids, x, far = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(ids)]), pa.array([far[0]]), pa.array([far[-1]]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["cell", "n", "lo", "hi", "ids", "matrix"])

        for batch in batches:
            ids, x, cell, far = batch.column(0).to_numpy(), rows_of(batch.column(1), batch.num_rows), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            i = 0
            while i < len(ids):
                if n and (cell[i] != at or n == ring):
                    yield made()
                    held, n = [], 0
                at = int(cell[i])
                j = min(int(np.searchsorted(cell[i:], at, "right")) + i, i + ring - n)
                held.append((ids[i:j], x[i:j], far[i:j]))
                n += j - i
                i = j
        if n:
            yield made()

    placed = plain.mapInArrow(assign, "id long, v array<double>, cell int, far double")
    ordered = placed.repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far", "id")
    packed = ordered.mapInArrow(pack, "cell int, n long, lo double, hi double, ids array<long>, matrix binary")
    packed.withColumn("ring", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rings")
    return Cells(vecs.sparkSession.read.parquet(f"{path}/rings"), centers, metric)


def bounds(cells: Cells, matrix: np.ndarray, reach: np.ndarray | None = None, seeds: int = SEEDS, k: int = 1) -> DataFrame:
    """q, ring, n, low: rings and the least distance from the query that a vector of them can have, with `reach` those within it,
    else each task's nearest, `seeds` or more that hold k vectors. Reads no vectors."""
    q, tiny = unit(matrix) if cells.metric == "cosine" else (matrix, np.zeros(len(matrix), bool))
    to_pivots = distances(q, cells.pivots)

    def lows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        ring, n, cell, lo, hi = (batch.column(i).to_numpy() for i in range(5))
        d = to_pivots[:, np.maximum(cell, 0)]
        low = np.maximum(np.maximum(d - hi[None, :], lo[None, :] - d), 0.0)
        low[:, cell < 0] = 0.0
        low[tiny] = 0.0
        return ring, n, low

    def made(q: np.ndarray, ring: np.ndarray, n: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ring), pa.array(n), pa.array(low)], names=["q", "ring", "n", "low"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring, n, low = lows(batch)
            i, j = np.nonzero(low <= reach[:, None])
            yield made(i, ring[j], n[j], low[i, j])

    def nearest_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(matrix)
        for batch in batches:
            ring, n, low = lows(batch)
            for i in range(len(matrix)):
                r, m, d = (np.concatenate(x) for x in zip(best[i], (ring, n, low[i]), strict=True))
                order = np.lexsort((r, d))
                enough = max(seeds, int(np.searchsorted(np.cumsum(m[order]), k)) + 1)
                best[i] = r[order[:enough]], m[order[:enough]], d[order[:enough]]
        yield made(np.repeat(np.arange(len(best)), [len(x[0]) for x in best]), *(np.concatenate(x) for x in zip(*best, strict=True)))

    return cells.rings.select("ring", "n", "cell", "lo", "hi").mapInArrow(nearest_few if reach is None else within, "q int, ring long, n long, low double")


def best_of_rings(cells: Cells, wanted: DataFrame, matrix: np.ndarray, k: int) -> DataFrame:
    """q, id, score: of each ring the k nearest to the queries that want it (ring, q), by the same arithmetic as a whole scan."""
    norms, metric = np.linalg.norm(matrix, axis=1), cells.metric
    wants = wanted.groupBy("ring").agg(F.collect_list("q").alias("qs"))  # a block of queries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_q, out_id, out_s = [], [], []
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values.to_numpy()
                x = np.frombuffer(batch.column(1)[i].as_py(), np.float64).reshape(len(ids), -1)
                qs = batch.column(2)[i].values.to_numpy()
                if metric == "l2":
                    s = np.stack([-np.round(((x - matrix[j]) ** 2).sum(axis=1), 9) for j in qs])
                else:
                    n = np.linalg.norm(x, axis=1)
                    short = (n[None, :] < vectors.TINY) | (norms[qs][:, None] < vectors.TINY)
                    s = np.round(np.where(short, 0.0, (matrix[qs] @ x.T) / np.where(short, 1.0, n[None, :] * norms[qs][:, None])), 9)
                for row, j in zip(s, qs, strict=True):
                    best = np.lexsort((ids, -row))[:k]
                    out_q += [int(j)] * len(best)
                    out_id += ids[best].tolist()
                    out_s += row[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int32()), pa.array(out_id, pa.int64()), pa.array(out_s, pa.float64())], names=["q", "id", "score"])

    rows = cells.rings.select("ring", "ids", "matrix").join(wants, "ring").select("ids", "matrix", "qs")
    return rows.mapInArrow(run, "q int, id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def plan(cells: Cells, matrix: np.ndarray, k: int, seeds: int = SEEDS, staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    """The nearest of each query's nearest rings (q, id, score, rank), and the other rings (ring, q) that may hold one as near."""
    staging = staging or Staging(cells.rings.sparkSession, "cells")
    order = W.partitionBy("q").orderBy("low", "ring")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = bounds(cells, matrix, None, seeds, k).withColumns({"no": F.row_number().over(order), "before": before}).where((F.col("no") <= seeds) | (F.col("before") < k)).select("ring", "q")
    first = staging.stored(first, "seeds")
    found = staging.stored(ranked(best_of_rings(cells, first, matrix, k), k), "first")
    reach = np.full(len(matrix), np.inf)
    for r in found.where(F.col("rank") == k).collect():  # one for each query of the block
        reach[r.q] = (-r.score) ** 0.5 if cells.metric == "l2" else max(2 - 2 * r.score, 0.0) ** 0.5
    if cells.metric == "cosine":
        reach[np.linalg.norm(matrix, axis=1) < vectors.TINY] = np.inf
    rest = bounds(cells, matrix, reach + SLACK).select("ring", "q").join(first, ["ring", "q"], "left_anti")
    return found, staging.stored(rest, "rest")


def nearest(cells: Cells, queries: list[tuple[str, list[float]]], k: int, seeds: int = SEEDS) -> DataFrame:
    """query_id, chunk_pos, score, rank: the k nearest of each query (l2: squared distance; cosine: the cosine), ties by number,
    equal to a whole scan's."""
    spark, out = cells.rings.sparkSession, None
    for lo in range(0, max(len(queries), 1), BLOCK):
        block = queries[lo : lo + BLOCK]
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], "q int, query_id string")
        if not block or not cells.rings.take(1):
            got = names.select("query_id", F.lit(0).cast("long").alias("chunk_pos"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        else:
            matrix = np.array([v for _, v in block], np.float64)
            if matrix.shape[1] != cells.size:
                raise ValueError(f"vectors of {cells.size} dimensions, queries of {matrix.shape[1]}")
            found, rest = plan(cells, matrix, k, seeds)
            every = found.drop("rank").unionByName(best_of_rings(cells, rest, matrix, k))
            got = ranked(every, k).join(names, "q").select("query_id", F.col("id").alias("chunk_pos"), "score", "rank")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("score", -F.col("score")) if cells.metric == "l2" else out
