"""Model calls as pluggable batch functions. A function takes a list and returns a list of the same length; the stand-ins
are deterministic, and no network is needed for them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = "DONE"


def batch_udf(make: Callable[[], Callable[[list], list]], result: str):
    """A pandas UDF over a model that each worker makes once."""

    @F.pandas_udf(result)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            out = model(batch.tolist())
            if len(out) != len(batch):
                raise RuntimeError(f"the model returned {len(out)} results for {len(batch)} inputs")
            yield pd.Series(out)

    return call


def embedded(chunks: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", out: str = "embedding") -> DataFrame:
    """chunks with an embedding by a model function."""
    return chunks.withColumn(out, batch_udf(make, "array<float>")(F.col(text)))


def embedded_requests(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: str = "batch_no", order: str = "chunk_pos", text: str = "text", out: str = "embedding") -> DataFrame:
    """rows with an embedding; the texts of one batch number go to the model in one call, and batches are spread over tasks."""
    kinds = [f"`{k}` {v}" for k, v in rows.dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = make(), []

        def called() -> pd.DataFrame:
            part = pd.concat(held)
            got = model(part[text].tolist())
            if len(got) != len(part):
                raise RuntimeError(f"the model returned {len(got)} results for {len(part)} inputs")
            return part.assign(**{out: got})

        for some in batches:
            for no, part in some.groupby(batch, sort=False):
                if held and held[0][batch].iloc[0] != no:
                    yield called()
                    held = []
                held.append(part)
        if held:
            yield called()

    return rows.repartition(batch).sortWithinPartitions(batch, order).mapInPandas(run, ", ".join([*kinds, f"`{out}` array<float>"]))


def checked_dimension(vector: Column, size: int) -> Column:
    """The vector, or an error if its dimension isn't that of the index."""
    return F.when(F.size(vector) == size, vector).otherwise(F.raise_error(F.lit(f"a vector of {size} dimensions is needed")))


def extractive_answer(prompt: str) -> str:
    """Stands in for a text model: the first numbered passage of the prompt's context."""
    found = re.search(r"(?ms)^\[1\][^\n]*\n(.*?)(?=^\[2\]|^<<<END_|\Z)", prompt)
    if not found or not found[1].strip():
        return "The report doesn't say."
    return found[1].strip()[:512]


def extractive_answers(prompts: list[str]) -> list[str]:
    return [extractive_answer(p) for p in prompts]


def never_refines(prompts: list[str]) -> list[str]:
    """Stands in for the model that may ask a second query."""
    return [DONE] * len(prompts)


def overlap_score(query: str, text: str) -> float:
    """Stands in for a cross-encoder: the share of the query's words that the text has."""
    q, t = (set(re.findall(r"\w+", x.lower())) for x in (query, text))
    return len(q & t) / len(q) if q else 0.0
