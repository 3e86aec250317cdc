"""Retrieval as one plan for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.config import Settings
from docspring.functions import calls
from docspring.functions.models import DONE
from docspring.functions.text import strip, strip_page_clause
from docspring.operators import fusion, rerank, sparse
from docspring.staging import Staging


def dense_pool(settings: Settings, filtered: bool) -> int:
    """Without a filter top_k candidates, with any filter five times as many, 50 at most."""
    return min(5 * settings.top_k, 50) if filtered else settings.top_k


def questions(asked: DataFrame, settings: Settings) -> DataFrame:
    """query_id, query (without its page clause), lo, hi: the window from 0 after intersecting the clause with the settings'."""
    parsed = asked.select("query_id", strip_page_clause("query").alias("p"))
    bound = [F.lit(None if x is None else x - 1).cast("long") for x in (settings.page_filter_min, settings.page_filter_max)]
    window = fusion.intersect_columns(F.col("p.lo") - 1, F.col("p.hi") - 1, *bound)
    return parsed.select("query_id", F.col("p.query").alias("query"), window["lo"].alias("lo"), window["hi"].alias("hi"))


def ranked(scored: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def hybrid(asked: DataFrame, chunks: DataFrame, dense: DataFrame, index: sparse.TermIndex | None, settings: Settings, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None, staging: Staging | None = None) -> DataFrame:
    """query_id, rank, chunk_pos, chunk_id, score, bonus and the chunk's columns.

    asked: query_id, query, lo, hi. dense: query_id, chunk_pos, rank of the vector leg. The pools are cut first, then fused,
    filtered by pages (or not at all where nothing passes), cut, reranked and cut to top_k. Scores stay those of the fusion.
    """
    ids = chunks.select("chunk_pos", "chunk_id")
    dense_ids = dense.join(ids, "chunk_pos").select("query_id", "chunk_pos", "chunk_id", "rank")
    legs, weights = [dense_ids], [settings.rrf_dense_weight]
    if settings.hybrid:
        found = sparse.sparse_topk(asked.select("query_id", "query"), index, settings.sparse_pool, staging=staging)
        legs.append(found.join(ids, "chunk_pos").select("query_id", "chunk_pos", "chunk_id", "rank"))
        weights.append(settings.rrf_sparse_weight)
    fused = fusion.fuse(legs, settings.rrf_k, weights)
    rows = fusion.with_rows(fused.withColumnRenamed("fused_rank", "rank"), chunks, dense_ids)
    rows = rows.join(asked.select("query_id", "query", "lo", "hi"), "query_id")
    kept = fusion.filter_or_all(rows, fusion.overlaps(F.col("lo"), F.col("hi")), 1 << 30)
    # unfiltered after all: three times top_k; else the cross-encoder's list
    cap = F.when(F.col("filtered"), F.lit(max(settings.top_k, settings.cross_encoder_top_n))).otherwise(F.least(F.lit(3 * settings.top_k), F.lit(max(settings.top_k, settings.cross_encoder_top_n))))
    cut = kept.withColumn("__n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("__n") <= cap).drop("__n")
    out = rerank.metadata_rerank(cut) if settings.metadata_boost else cut.withColumn("bonus", F.lit(0.0))
    if settings.cross_encoder_model:
        out, _ = rerank.cross_encoder_rerank(out, scorer)
    return ranked(out.withColumnRenamed("rank", "__r"), ["__r"], settings.top_k).withColumnRenamed("rrf", "score").drop("__r", "first_seen")


def dense_only(asked: DataFrame, chunks: DataFrame, dense: DataFrame, settings: Settings) -> DataFrame:
    """The vector leg alone: filtered by pages, or its first top_k where nothing passes."""
    rows = dense.join(chunks, "chunk_pos").join(asked.select("query_id", "query", "lo", "hi"), "query_id")
    kept = fusion.filter_or_all(rows, fusion.overlaps(F.col("lo"), F.col("hi")), settings.top_k)
    return ranked(kept.withColumnRenamed("rank", "__r"), ["__r"], settings.top_k).drop("__r")


def dual(asked: DataFrame, chunks: DataFrame, local_dense: DataFrame, remote_dense: DataFrame, index: sparse.TermIndex | None, settings: Settings, scorer=None, staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    """The local leg (hybrid, or dense where there is no index of terms) and the remote leg (dense, never filtered), side by side."""
    if settings.hybrid and index is not None:
        local = hybrid(asked, chunks, local_dense, index, settings, scorer, staging)
    else:
        local = dense_only(asked, chunks, local_dense, settings)
    remote = ranked(remote_dense.withColumnRenamed("rank", "__r"), ["__r"], settings.top_k).drop("__r").join(chunks, "chunk_pos")
    return local, remote


def refinement_prompts(asked: DataFrame, hits: DataFrame, most: int = 4, chars: int = 800) -> DataFrame:
    """query_id, prompt: the question and the beginnings of the first hits, for a model that answers DONE or one new query."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.substring("text", 1, chars)).alias("t"))))
    seen = hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("seen"))
    text = F.concat(F.lit("Question: "), F.col("query"), F.lit("\nPassages so far:\n"), F.coalesce("seen", F.lit("(none)")), F.lit("\nReply DONE if they suffice, else one short search query."))
    return asked.join(seen, "query_id", "left").select("query_id", text.alias("prompt"))


def follow_up(reply: Column, query: Column, most: int = 512) -> Column:
    """The reply's first line that isn't blank, cut; null if it is DONE, the question again, or nothing."""
    lines = F.filter(F.transform(F.split(reply, "\\R"), strip), lambda x: x != "")
    line = F.substring(F.try_element_at(lines, F.lit(1)), 1, most)
    return F.when((F.upper(F.rtrim(line, F.lit("."))) != DONE) & (F.lower(line) != F.lower(query)), line)


def multi_hop(asked: DataFrame, search: Callable[[DataFrame], DataFrame], refine: Callable[[list[str]], list[str]] | None, settings: Settings, staging: Staging | None = None, limits: calls.Limits = calls.Limits()) -> tuple[DataFrame, DataFrame]:
    """Hits of one or two passes, and for each query its note, and the follow-up's digest and length if there was one.

    The model is called on executors, in batches. Hits and replies of the first pass are staged, so nothing is searched or asked
    twice, and only follow-ups are searched again; a model that fails costs its query the second pass and gives a note. Queries
    without a hit aren't refined."""
    first = search(asked)
    none = [F.lit(None).cast("string").alias("follow_sha256"), F.lit(None).cast("int").alias("follow_length")]
    if not settings.multi_hop or refine is None:
        return first, asked.select("query_id", F.lit("multi_hop_disabled").alias("note"), *none)
    held = staging or Staging(asked.sparkSession, "multi-hop")
    first = held.stored(first, "first")
    some = asked.join(first.select("query_id").distinct(), "query_id", "left_semi")
    call = calls.attempted(lambda: refine, "multi_hop_failed", limits)
    answered = refinement_prompts(some, first).select("query_id", call("prompt").alias("r"))
    told = held.stored(asked.join(answered, "query_id", "left").withColumn("follow", follow_up(F.col("r.value"), F.col("query"))), "replies")
    note = F.when(F.col("r").isNull(), "multi_hop_empty").when(F.col("r.error").isNotNull(), F.col("r.error")).when(F.col("follow").isNotNull(), "multi_hop_second_pass").otherwise("multi_hop_done")
    notes = told.select("query_id", note.alias("note"), F.sha2("follow", 256).alias("follow_sha256"), F.length("follow").alias("follow_length"))
    again = told.where("follow is not null").withColumn("query", F.col("follow")).select(*asked.columns)
    if again.isEmpty():
        return first, notes
    return fusion.merge_passes(first, search(again), settings.top_k), notes
