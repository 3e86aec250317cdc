"""The index as Parquet with a manifest, its terms, patches, and traces."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspring.operators import sparse
from docspring.sources.segments import SegmentedTerms
from docspring.staging import filesystem

FORMAT = "docspring_index_v1"
MANIFEST = "manifest.json"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside, then renamed into place."""
    target, fs = filesystem(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(staged, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    target, fs = filesystem(spark, path)
    if not fs.exists(target):
        return None
    return spark.read.text(path, wholetext=True).head()[0]


def save_index(chunks: DataFrame, path: str) -> None:
    """The corpus replaces the one before; the manifest follows the data, so a half-written index has none. Rows of one id
    stay apart here."""
    spark = chunks.sparkSession
    target, fs = filesystem(spark, f"{path}/{MANIFEST}")
    fs.delete(target, False)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    n = spark.read.parquet(f"{path}/chunks").count()
    write_text(spark, f"{path}/{MANIFEST}", json.dumps({"format": FORMAT, "rows": n, "written": time.time()}))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    raw = read_text(spark, f"{path}/{MANIFEST}")
    if raw is None:
        raise FileNotFoundError(f"no index in {path}")
    found = json.loads(raw)
    if found.get("format") != FORMAT:
        raise RuntimeError(f"the index in {path} has the format {found.get('format')!r}; write it again")
    return spark.read.parquet(f"{path}/chunks")


def freshness_key(spark: SparkSession, path: str) -> str:
    """The index's path and the latest change of its files."""
    p, fs = filesystem(spark, path)
    if not fs.exists(p):
        return f"{path}:0.000000000"
    files, latest = fs.listFiles(p, True), 0
    while files.hasNext():
        latest = max(latest, files.next().getModificationTime())
    return f"{path}:{latest / 1000:.9f}"


class TermTables:
    """The index of terms beside each index, brought up to date when that changes: by its changed documents alone."""

    def __init__(self):
        self.held: dict[str, tuple[str, sparse.TermIndex]] = {}

    def get(self, spark: SparkSession, path: str) -> tuple[sparse.TermIndex, bool]:
        """The index of terms, and whether it was there already."""
        key, held = freshness_key(spark, f"{path}/chunks"), self.held.get(path)
        if held and held[0] == key:
            return held[1], True
        chunks, terms = load_index(spark, path), SegmentedTerms(spark, f"{path}/terms")
        terms.upsert(chunks, whole=True)
        made = terms.index(chunks)
        self.held[path] = (key, made)
        return made, False


def upsert_patches(patches: DataFrame, path: str, append: bool = False) -> None:
    """Flat payloads of 17 fields with their vectors."""
    patches.write.mode("append" if append else "overwrite").parquet(f"{path}/patches")


def trace_rows(asked: DataFrame) -> DataFrame:
    """What may be logged of a question: its digest and length."""
    return asked.select("query_id", F.sha2("query", 256).alias("query_sha256"), F.length("query").alias("query_char_length"))
