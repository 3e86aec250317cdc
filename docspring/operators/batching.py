"""Keys and batches of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in this order: an upsert overwrites. One aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return last.select(*(F.col(c) if c == key else F.col(f"__last.{c}").alias(c) for c in rows.columns))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows side by side by key; a key on one side only is an error, as two lists of different lengths would be."""
    both = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), key, "full")
    whole = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.raise_error(F.lit("the two sides don't have the same rows"))).otherwise(F.col(key))
    return both.withColumn(key, whole).drop("__l", "__r")
