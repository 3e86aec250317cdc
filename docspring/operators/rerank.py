"""Reranking of hits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import vectors
from docspring.functions.text import tokens

# The words and weights of the bonus.
VISUAL_WORDS = ("chart", "graph", "diagram", "plot", "visual", "image")
FIGURE_BONUS, VISUAL_BONUS, TABLE_BONUS, WORD_BONUS = 1.5, 1.35, 1.5, 0.25


def metadata_bonus(query: Column) -> Column:
    """By the content type, kind and section hint of a hit."""
    q, kind = F.lower(query), F.lower(F.coalesce("chunk_kind", F.lit("")))
    ct, hint = F.lower(F.coalesce("content_type", F.lit(""))), F.lower(F.coalesce("section_hint", F.lit("")))
    visual = F.lit(False)
    for w in VISUAL_WORDS:
        visual = visual | q.contains(w)
    words = F.size(F.filter(F.array_distinct(tokens(query)), lambda t: (F.length(t) > 3) & F.contains(hint, t)))
    part = lambda when, value: F.when(when, F.lit(value)).otherwise(F.lit(0.0))
    return (
        part(q.contains("figure") & ct.contains("figure"), FIGURE_BONUS)
        + part(visual & (ct.contains("figure") | ct.contains("visual") | (kind == "pdf_image")), VISUAL_BONUS)
        + part(q.contains("table") & ct.contains("table"), TABLE_BONUS)
        + F.lit(WORD_BONUS) * F.when(hint != "", words).otherwise(0)
    )


def reranked(hits: DataFrame, score: Column, order: str = "rank", out: str = "rank") -> DataFrame:
    """By descending score, then the order before."""
    return hits.withColumn("__s", score).withColumn(out, F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("__s"), F.col(order)))).drop("__s")


def metadata_rerank(hits: DataFrame, order: str = "rank", out: str = "rank") -> DataFrame:
    """hits has the query's text in `query`. Scores stay as they are."""
    return reranked(hits.withColumn("bonus", metadata_bonus(F.col("query"))), F.col("bonus"), order, out)


def cross_encoder_rerank(hits: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]] | None, order: str = "rank") -> tuple[DataFrame, str | None]:
    """By a model's scores of pairs (query, text), a list of them at a time; without a model the order stays, with a note."""
    if scorer is None:
        return hits, "cross_encoder_unavailable"

    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(queries, texts, strict=True))), dtype="float64")

    return reranked(hits, score("query", "text"), order), None


def maxsim_rerank(coarse: DataFrame, query: Column, n_slots: int, k: int, id_col: str, vector: str = "embedding") -> DataFrame:
    """The k best of each question's coarse list (query_id, id, score, vector) by late interaction with the question's vector,
    then by the coarse score. Rows without a vector are left out."""
    usable = coarse.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    fine = usable.withColumn("maxsim", F.round(vectors.maxsim(vectors.slots(query, n_slots), vectors.slots(vector, n_slots)), 9))
    order = W.partitionBy("query_id").orderBy(F.desc("maxsim"), F.desc("score"), id_col)
    return fine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
