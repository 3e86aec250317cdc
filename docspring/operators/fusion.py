"""Rank fusion, page windows, and ranked ids to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN = 10**9
LEG = 1_000_000


def fuse(legs: list[DataFrame], k: int = 60, weights: list[float] | None = None, key: str = "chunk_id") -> DataFrame:
    """query_id, key, rrf, first_seen, fused_rank from legs of (query_id, key, rank). Ties by first sight, the first leg before
    the others. An id that occurs twice in a leg counts twice."""
    weights = [1.0] * len(legs) if weights is None else weights
    if len(weights) != len(legs):
        raise ValueError(f"{len(weights)} weights for {len(legs)} legs")
    parts = [leg.select("query_id", key, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("share"), (F.lit(i * LEG) + F.col("rank")).cast("long").alias("seen")) for i, (leg, w) in enumerate(zip(legs, weights, strict=True))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", key).agg(F.round(F.sum("share"), 12).alias("rrf"), F.min("seen").alias("first_seen"))
    return fused.withColumn("fused_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf"), "first_seen")))


def intersect_columns(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Two windows of pages, counted from 0, to struct(lo, hi); an end that is null is open. Null, which filters nothing, if all
    ends are open or the windows are disjoint."""
    lo, hi = F.greatest(F.coalesce(lo1, F.lit(0)), F.coalesce(lo2, F.lit(0))), F.least(F.coalesce(hi1, F.lit(OPEN)), F.coalesce(hi2, F.lit(OPEN)))
    none = lo1.isNull() & hi1.isNull() & lo2.isNull() & hi2.isNull()
    return F.when(~none & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def overlaps(lo: Column, hi: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """A chunk's pages meet the window; a null window keeps all."""
    start, end = start if start is not None else F.col("page_start"), end if end is not None else F.col("page_end")
    return lo.isNull() | ((F.coalesce(end, start, F.lit(0)) >= lo) & (F.coalesce(start, F.lit(0)) <= hi))


def filter_or_all(hits: DataFrame, keep: Column, cap: int, order: str = "rank") -> DataFrame:
    """Hits of each query that pass, or all of them if none does, cut to `cap`; filtered says which."""
    per = W.partitionBy("query_id")
    flagged = hits.withColumn("__keep", keep).withColumn("__passed", F.count_if("__keep").over(per))
    some = flagged.where(F.col("__keep") | (F.col("__passed") == 0)).withColumn("filtered", F.col("__passed") > 0).drop("__keep", "__passed")
    return some.withColumn("__n", F.row_number().over(per.orderBy(order))).where(F.col("__n") <= cap).drop("__n")


def with_rows(ranked: DataFrame, chunks: DataFrame, dense_ids: DataFrame | None = None) -> DataFrame:
    """The chunk behind each ranked id: of equal ids the last that the dense leg returned, else the first of the corpus. Ids
    without a chunk are dropped."""
    wanted = chunks.join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    firsts = wanted.groupBy("chunk_id").agg(F.min("chunk_pos").alias("__first"))
    picked = ranked.drop("chunk_pos").join(firsts, "chunk_id")
    if dense_ids is not None:
        chosen = dense_ids.groupBy("query_id", "chunk_id").agg(F.max_by("chunk_pos", "rank").alias("__pos"))
        picked = picked.join(chosen, ["query_id", "chunk_id"], "left").withColumn("__first", F.coalesce("__pos", "__first")).drop("__pos")
    return picked.withColumnRenamed("__first", "chunk_pos").join(wanted.drop("chunk_id"), "chunk_pos")


def merge_passes(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The first pass, then the second; of a repeated id the first counts, blank ids never repeat; cut to k. rank is new."""
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)), allowMissingColumns=True)
    key = F.when(F.trim(F.coalesce("chunk_id", F.lit(""))) == "", F.concat_ws("\0", F.lit(""), "pass", "rank")).otherwise(F.concat(F.lit("="), F.col("chunk_id")))
    order = W.partitionBy("query_id").orderBy("pass", "rank")
    once = both.withColumn("__key", key).withColumn("__n", F.row_number().over(W.partitionBy("query_id", "__key").orderBy("pass", "rank"))).where("__n = 1").drop("__key", "__n")
    return once.withColumn("merged_rank", F.row_number().over(order)).where(F.col("merged_rank") <= k)
