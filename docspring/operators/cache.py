"""The answer cache: similar questions get the stored answer."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspring.functions import vectors
from docspring.schemas import CACHE
from docspring.staging import deleted, filesystem

SCHEMA = f"{CACHE}, pos long, id string"


def eligible(inline_window, page_min, page_max) -> bool:
    """Answers under a page filter are neither stored nor looked up."""
    return inline_window is None and page_min is None and page_max is None


def eligible_column(lo: Column, page_min: Column, page_max: Column) -> Column:
    return lo.isNull() & page_min.isNull() & page_max.isNull()


def probe(queries: DataFrame, cache: DataFrame, threshold: float = 0.92, most: int = 10_000) -> DataFrame:
    """query_id, answer, similarity of the most similar entry of each query, the earliest of equal ones, from the threshold on.

    queries has query_id and embedding, the cache answer, embedding and pos. A cache has a size limit: its entries, `most` of
    them at most, are sent to the tasks as a matrix; with more this raises."""
    entries = cache.select("answer", vectors.doubles("embedding").alias("embedding"), "pos").orderBy("pos").limit(most + 1).collect()
    if len(entries) > most:
        raise ValueError(f"the cache has more than {most} entries; evict first")
    sizes = {len(e.embedding or ()) for e in entries}
    matrices = {n: np.array([e.embedding for e in entries if len(e.embedding or ()) == n], np.float64) for n in sizes if n}
    answers = {n: [e.answer for e in entries if len(e.embedding or ()) == n] for n in matrices}
    norms = {n: np.linalg.norm(m, axis=1) for n, m in matrices.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = matrices.get(len(v or ()))
                if m is None:
                    continue
                length = np.linalg.norm(v)
                tiny = (norms[len(v)] < vectors.TINY) | (length < vectors.TINY)
                near = np.round(np.where(tiny, 0.0, (m @ np.array(v)) / np.where(tiny, 1.0, norms[len(v)] * length)), 9)
                at = int(near.argmax())
                if near[at] >= threshold:
                    out.append((q, answers[len(v)][at], float(near[at])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["query_id", "answer", "similarity"])

    return queries.select(F.col("query_id").cast("string").alias("query_id"), vectors.doubles("embedding").alias("embedding")).mapInArrow(run, "query_id string, answer string, similarity double")


def newest(cache: DataFrame, most: int) -> DataFrame:
    """Entries by descending created_ts, then position; older ones go, whether they were used or not."""
    return cache.orderBy(F.desc("created_ts"), F.desc("pos")).limit(most)


class AnswerCache:
    """Entries in a folder that all sessions share: each addition is a segment of its own, seen when it is complete, so two
    sessions that write at once lose nothing. Segments are put together when there are many; an entry that a broken-off or
    parallel compaction left twice counts once."""

    def __init__(self, path: str, most: int = 256, segments: int = 16):
        self.path, self.most, self.segments = path.rstrip("/"), most, segments

    def _listed(self, spark: SparkSession) -> list[str]:
        """The complete segments, by name, which is by time."""
        p, fs = filesystem(spark, self.path)
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        done = [x for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(x.toString() for x in done)

    def table(self, spark: SparkSession) -> DataFrame:
        """All entries: embedding, answer, created_ts, pos and id. Those beyond the newest `most` don't count any more."""
        some = self._listed(spark)
        return spark.read.schema(SCHEMA).parquet(*some).dropDuplicates(["id"]) if some else spark.createDataFrame([], SCHEMA)

    def append(self, entries: DataFrame) -> None:
        """Entries (embedding, answer, and if given created_ts and pos, the order of entries of one time) as a segment."""
        now = time.time()
        has = lambda c, other: F.col(c) if c in entries.columns else other
        rows = entries.select(vectors.doubles("embedding").alias("embedding"), "answer", has("created_ts", F.lit(now)).cast("double").alias("created_ts"), has("pos", F.lit(int(now * 1e6))).cast("long").alias("pos"), F.uuid().alias("id"))
        rows.where("embedding is not null and answer is not null").write.parquet(f"{self.path}/{int(now * 1000):014d}-{uuid.uuid4().hex}")
        if len(self._listed(entries.sparkSession)) > self.segments:
            self.compact(entries.sparkSession)

    def put(self, spark: SparkSession, embedding: list[float], answer: str, now: float | None = None) -> None:
        rows = spark.createDataFrame([([float(x) for x in embedding], answer, float(time.time() if now is None else now))], CACHE)
        self.append(rows.coalesce(1))

    def compact(self, spark: SparkSession) -> None:
        """The newest entries of the segments that are there now as one, then those are deleted; segments that come meanwhile stay."""
        some = self._listed(spark)
        if len(some) < 2:
            return
        held = spark.read.schema(SCHEMA).parquet(*some).dropDuplicates(["id"])
        newest(held, self.most).coalesce(1).write.parquet(f"{self.path}/{int(time.time() * 1000):014d}-{uuid.uuid4().hex}")
        for x in some:
            deleted(spark, x)

    def lookup(self, spark: SparkSession, embedding: list[float], threshold: float) -> tuple[str, float] | None:
        asked = spark.createDataFrame([("q", [float(x) for x in embedding])], "query_id string, embedding array<double>")
        got = self.lookups(asked, threshold).collect()
        return (got[0].answer, got[0].similarity) if got else None

    def lookups(self, queries: DataFrame, threshold: float) -> DataFrame:
        """query_id, answer, similarity for the queries (query_id, embedding) that an entry of the newest is near enough to. A
        segment that a compaction deletes while it is read is looked for again."""
        spark = queries.sparkSession
        try:
            return probe(queries, newest(self.table(spark), self.most), threshold)
        except Exception as e:
            if "FILE_NOT_EXIST" not in str(e) and "FileNotFound" not in str(e):
                raise
            return probe(queries, newest(self.table(spark), self.most), threshold)
