"""Ordered greedy folds and running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTEXT, SEPARATOR = 12_000, 2
#: Values of the order that one task folds together.
SPAN = 100_000


def embed_batches(rows: DataFrame, batch_size: int = 250, budget: int = 18_000, group: str = "corpus", order: str = "chunk_pos", span: int = SPAN) -> DataFrame:
    """group, order, need and batch_no: a batch ends at `batch_size` texts, or before the text with which it would go over the
    budget of estimated tokens. A text over the budget by itself is an error.

    The fold is cut into ranges of `span` values of the order. Each range tells for every place where its first new batch
    may begin how it ends; those ends are chained, a few numbers for each range, and then every range is folded from the
    state that it is entered with. So one corpus is spread over as many tasks as it has ranges.
    """
    if batch_size < 1 or budget < 1:
        raise ValueError("batch size and budget must be positive")
    need = F.greatest(F.lit(1), F.floor(F.length("text") / 2.0) + 1).cast("long")
    whole = F.when(need > budget, F.raise_error(F.lit("a text is over the budget of one request"))).otherwise(need)
    kinds = dict(rows.dtypes)
    base = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), whole.alias("need"), F.floor(F.col(order) / span).cast("long").alias("r"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, r, needs in runs_of(batches):
            sums = np.cumsum(needs)
            before = sums - needs
            following = np.minimum(np.arange(len(needs)) + batch_size, np.searchsorted(sums, before + budget, "right"))
            end = np.empty((len(needs), 3), np.int64)  # of the batch that is open at the end: texts, tokens; batches begun
            for i in range(len(needs) - 1, -1, -1):
                k = following[i]
                end[i] = (len(needs) - i, sums[-1] - before[i], 1) if k == len(needs) else end[k] + (0, 0, 1)
            head = end[: batch_size + 1]
            yield pd.DataFrame({"g": [g], "r": [r], "size": [len(needs)], "head": [needs[:batch_size]], "n": [head[:, 0]], "used": [head[:, 1]], "begun": [head[:, 2]]})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, used, no = object(), 0, 0, 0
        for batch in batches:
            out = []
            for x in batch.itertuples():
                if not same(x.g, at):
                    at, n, used, no = x.g, 0, 0, -1
                out.append((n, used, no))
                taken = 0 if no < 0 else min(batch_size - n, int(np.searchsorted(np.cumsum(x.head), budget - used, "right")))
                if taken < x.size:
                    n, used, no = int(x.n[taken]), int(x.used[taken]), no + int(x.begun[taken])
                else:
                    n, used = n + x.size, used + int(np.sum(x.head))
            yield batch[["g", "r"]].assign(**{c: [o[k] for o in out] for k, c in enumerate(("n", "used", "no"))})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, used, no = (object(), None), 0, 0, 0
        for batch in batches:
            out = []
            for x in batch.itertuples():
                if not (same(x.g, at[0]) and x.r == at[1]):
                    at, n, used, no = (x.g, x.r), x.n, x.used, x.no
                if no < 0 or n == batch_size or used + x.need > budget:
                    n, used, no = 0, 0, no + 1
                n, used = n + 1, used + x.need
                out.append(no)
            yield batch[["g", "o", "need"]].assign(batch_no=out)

    found = base.repartition("g", "r").sortWithinPartitions("g", "r", "o").mapInPandas(ends, f"g {kinds[group]}, r long, size long, head array<long>, n array<long>, used array<long>, begun array<long>")
    entered = found.repartition("g").sortWithinPartitions("g", "r").mapInPandas(chain, f"g {kinds[group]}, r long, n long, used long, no long")
    joined = base.alias("b").join(entered.alias("e"), F.col("b.g").eqNullSafe(F.col("e.g")) & (F.col("b.r") == F.col("e.r"))).select("b.g", "b.r", "b.o", "b.need", "e.n", "e.used", "e.no")
    folded = joined.repartition("g", "r").sortWithinPartitions("g", "r", "o").mapInPandas(fold, f"g {kinds[group]}, o {kinds[order]}, need long, batch_no long")
    return folded.select(F.col("g").alias(group), F.col("o").alias(order), "need", "batch_no")


def same(a: object, b: object) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """g, r and the needs of each range, of rows in the order of both."""
    key, held = None, []
    for batch in batches:
        for (g, r), part in batch.groupby(["g", "r"], sort=False, dropna=False):
            if key is not None and not (same(key[0], g) and key[1] == r):
                yield *key, np.concatenate(held)
                held = []
            key = (None if g != g else g, r)
            held.append(part["need"].to_numpy(np.int64))
    if key is not None:
        yield *key, np.concatenate(held)


def context_blocks(hits: DataFrame) -> DataFrame:
    """With block: a numbered header and the hit's text; pages as they are stored, from 0."""
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    kind = F.coalesce(F.nullif("chunk_kind", F.lit("")), F.lit("narrative"))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] pages "), page("page_start"), F.lit("–"), page("page_end"), F.lit(" · "), F.coalesce("content_type", F.lit("?")), F.lit(" · "), kind)
    return hits.withColumn("block", F.concat(head, F.lit("\n"), F.col("text")))


def packed_context(hits: DataFrame, most: int = CONTEXT) -> DataFrame:
    """The blocks of each query up to the first that doesn't fit; what follows it is left out, even if it would fit."""
    per = W.partitionBy("query_id").orderBy("rank")
    sized = context_blocks(hits).withColumn("__n", F.length("block"))
    used = F.sum(F.col("__n") + SEPARATOR).over(per.rowsBetween(W.unboundedPreceding, W.currentRow)) - SEPARATOR
    over = sized.withColumn("__over", (used > most).cast("int"))
    stopped = over.withColumn("__stop", F.max("__over").over(per.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return stopped.where("__stop = 0").drop("__n", "__over", "__stop")


def context_text(packed: DataFrame) -> DataFrame:
    """query_id, context, table_context, visual_context."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", "block")))
    low = F.lower(F.coalesce("content_type", F.lit("")))
    tables = F.bool_or((F.col("chunk_kind") == "pdf_table") | low.contains("table_structured"))
    figures = F.bool_or((F.col("chunk_kind") == "pdf_image") | low.contains("figure_visual"))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("context"), F.coalesce(tables, F.lit(False)).alias("table_context"), F.coalesce(figures, F.lit(False)).alias("visual_context"))


def hit_texts(hits: DataFrame) -> DataFrame:
    """query_id and the hits' texts in order."""
    return hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("retrieved_contexts"))
