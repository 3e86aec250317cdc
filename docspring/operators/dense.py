"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import vectors
from docspring.functions.text import tokens
from docspring.operators import sparse


#: Queries whose matrix is sent to the tasks at a time.
BLOCK = 2048
#: Pairs of a query and a vector that a task compares by late interaction, and those that it holds at a time (queries, vectors).
PAIRS, TILE = 8_000_000, (64, 256)


def l2_topk(vecs: DataFrame, query: Column, k: int, id_col: str = "chunk_pos", vector: str = "embedding") -> DataFrame:
    """The k nearest by squared distance, ties by id; k is clamped to what is there."""
    scored = vecs.select(id_col, F.round(vectors.l2_squared(vector, query), 9).alias("score"))
    return scored.orderBy("score", id_col).limit(max(k, 1))


def cosine_topk(vecs: DataFrame, query: Column, k: int, id_col: str = "chunk_pos", vector: str = "embedding") -> DataFrame:
    scored = vecs.select(id_col, F.round(vectors.cosine(vector, query), 9).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(max(k, 1))


def batch_topk(vecs: DataFrame, queries: list[tuple[str, list[float]]], k: int, metric: str = "l2", id_col: str = "chunk_pos", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank for a set of queries: a matrix product for each Arrow batch, the k best of a partition, then
    the k best of all. Queries go in blocks of BLOCK, each with one pass over the table and its matrix sent to every task."""
    if not queries:
        kind = dict(vecs.dtypes)[id_col]
        return vecs.sparkSession.createDataFrame([], f"query_id string, {id_col} {kind}, score double, rank int")
    if len(queries) > BLOCK:
        out = batch_topk(vecs, queries[:BLOCK], k, metric, id_col, vector)
        for lo in range(BLOCK, len(queries), BLOCK):
            out = out.unionByName(batch_topk(vecs, queries[lo : lo + BLOCK], k, metric, id_col, vector))
        return out
    kind = dict(vecs.dtypes)[id_col]
    names = [q for q, _ in queries]
    matrix = np.array([v for _, v in queries], np.float64)
    norms = np.linalg.norm(matrix, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, "U1" if kind == "string" else np.int64)) for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(0).to_pylist())
            rows = batch.column(1)
            x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
            if x.shape[1] != matrix.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} dimensions, queries of {matrix.shape[1]}")
            if metric == "l2":
                s = -np.round(np.stack([((x - q) ** 2).sum(axis=1) for q in matrix]), 9)
            else:
                n = np.linalg.norm(x, axis=1)
                tiny = (n[None, :] < vectors.TINY) | (norms[:, None] < vectors.TINY)
                s = np.round(np.where(tiny, 0.0, (matrix @ x.T) / np.where(tiny, 1.0, n[None, :] * norms[:, None])), 9)
            for i in range(len(names)):
                score, which = np.concatenate([best[i][0], s[i]]), np.concatenate([best[i][1], ids])
                top = np.lexsort((which, -score))[:k]
                best[i] = score[top], which[top]
        rows = [(names[i], d.item(), float(v)) for i, (score, which) in enumerate(best) for v, d in zip(score, which, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string() if kind == "string" else pa.int64(), pa.float64()), strict=True)], names=["query_id", id_col, "score"])

    id_kind = "string" if kind == "string" else "long"
    found = vecs.select(F.col(id_col).cast(id_kind).alias(id_col), F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull()).mapInArrow(run, f"query_id string, {id_col} {id_kind}, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.when(F.lit(metric == "l2"), -F.col("score")).otherwise(F.col("score")))


def slot_rows(x: np.ndarray, n: int) -> np.ndarray:
    """Vectors as arrays of n rows of equal width, each a unit long."""
    if not x.shape[1] or x.shape[1] % n:
        raise ValueError(f"vectors of {x.shape[1]} dimensions can't be cut into {n} slots")
    cut = x.reshape(len(x), n, -1)
    return cut / np.maximum(np.linalg.norm(cut, axis=2, keepdims=True), vectors.FLOOR)


def maxsim_pairs(vecs: DataFrame, queries: DataFrame, n_slots: int, id_col: str = "chunk_pos", vector: str = "embedding") -> DataFrame:
    """query_id, id, maxsim of every query (query_id, embedding) with every vector, by matrix products in tiles; null where one of
    both is null. Queries go in blocks of BLOCK, and vectors are dealt out so that a task makes some PAIRS at most."""
    kind = dict(vecs.dtypes)[id_col]
    out, total = vecs.sparkSession.createDataFrame([], f"query_id string, {id_col} {kind}, maxsim double"), vecs.count()
    rows = vecs.select(id_col, F.col(vector).cast("array<double>").alias(vector))
    for block in in_blocks(queries):
        dealt = rows.repartition(max(1, -(-total * len(block) // PAIRS)))
        out = out.unionByName(dealt.mapInArrow(interactions(block, n_slots, id_col), out.schema))
    return out


def interactions(queries: list[tuple[str, list[float] | None]], n_slots: int, id_col: str):
    """The function of a task of maxsim_pairs."""
    width = max((len(v) for _, v in queries if v is not None), default=0)
    names, missing = [q for q, _ in queries], np.array([v is None for _, v in queries])
    matrix = np.array([[0.0] * width if v is None else v for _, v in queries], np.float64)

    def tiles(ids: pa.Array, column: pa.Array, asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(ids), TILE[1]):
            some, valid = column.slice(lo, TILE[1]), column.slice(lo, TILE[1]).is_valid().to_numpy(zero_copy_only=False)
            held = None
            if valid.any() and asked is not None:
                flat = np.asarray(some.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(int(valid.sum()), -1)
                if flat.shape[1] != width:
                    raise ValueError(f"vectors of {flat.shape[1]} dimensions, queries of {width}")
                held = np.zeros((len(some), n_slots, width // n_slots))
                held[valid] = slot_rows(flat, n_slots)
            for q in range(0, len(names), TILE[0]):
                n = len(names[q : q + TILE[0]])
                score = np.zeros((n, len(some)))
                if held is not None:
                    left, best = asked[q : q + n].reshape(n * n_slots, -1), None
                    for j in range(n_slots):
                        cosines = left @ held[:, j].T
                        best = cosines if best is None else np.maximum(best, cosines, out=best)
                    score = best.reshape(n, n_slots, -1).sum(axis=1)
                none = missing[q : q + n, None] | ~valid[None, :]
                named = pa.array(names[q : q + n], pa.string()).take(pa.array(np.repeat(np.arange(n), len(some))))
                which = ids.slice(lo, len(some)).take(pa.array(np.tile(np.arange(len(some)), n)))
                yield pa.RecordBatch.from_arrays([named, which, pa.array(score.ravel(), pa.float64(), mask=none.ravel())], names=["query_id", id_col, "maxsim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = slot_rows(matrix, n_slots) if width else None
        for batch in batches:
            yield from tiles(batch.column(0), batch.column(1), asked)

    return run


def bucket_of(term: Column | str, size: int = 64) -> Column:
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % size).cast("int")


def hashed_vectors(words: DataFrame, key: str, size: int = 64) -> DataFrame:
    """key and embedding, the counts of its tokens by bucket, from rows of key, bucket and tf: the hashing stand-in's vectors
    before they are made a unit long."""
    counts = words.groupBy(key, "bucket").agg(F.sum("tf").cast("double").alias("tf"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "tf"))).alias("m"))  # size of them at most
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("embedding"))


def block_vectors(index: sparse.TermIndex, size: int = 64) -> DataFrame:
    """chunk_pos and embedding of the chunks of an index made anew, as hashed_vectors() gives them from its postings. Posting lists
    move once, to the task of their block, which holds one block's counts by place and bucket."""
    span = index.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros((span, size))

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(held.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(held[at].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(key * span + at), lists], names=["chunk_pos", "embedding"])

        for batch in batches:
            block, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if key is not None and block[lo] != key:
                    yield done()
                    held[:] = 0.0
                key = int(block[lo])
                ats, tfs = batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)
                where = ats.flatten().to_numpy().astype(np.int64) * size + np.repeat(bucket[lo:hi], ats.value_lengths().to_numpy())
                held += np.bincount(where, tfs.flatten().to_numpy(), span * size).reshape(span, size)
        if key is not None:
            yield done()

    rows = index.blocks.select("block", bucket_of("term", size).alias("bucket"), "ats", "tfs")
    return rows.repartition(sparse.parts_of(index.n), "block").sortWithinPartitions("block").mapInArrow(run, "chunk_pos long, embedding array<double>")


def question_vectors(queries: DataFrame, size: int = 64) -> DataFrame:
    words = queries.select("query_id", F.explode(tokens("query")).alias("term"))
    return hashed_vectors(words.select("query_id", bucket_of("term", size).alias("bucket"), F.lit(1).alias("tf")), "query_id", size)


def in_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[str, list[float] | None]]]:
    """Queries (query_id, embedding) as lists of at most so many: the driver holds one partition's and one block's at a time."""
    held: list[tuple[str, list[float] | None]] = []
    for r in queries.select(F.col("query_id").cast("string"), "embedding").toLocalIterator():
        held.append((r[0], None if r[1] is None else list(r[1])))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def blocks_topk(vecs: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """batch_topk for queries in a table (query_id, embedding), block by block."""
    out = batch_topk(vecs, [], k)
    for block in in_blocks(queries):
        out = out.unionByName(batch_topk(vecs, block, k, metric))
    return out


def hashed_topk(vecs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_pos, score, rank by the stand-in's vectors: those of chunks (chunk_pos, embedding) against those of the
    questions, by matrix products. Chunks that have no bucket of the question's aren't found."""
    return blocks_topk(vecs, question_vectors(queries), k, "cosine").where(F.col("score") > 0)
