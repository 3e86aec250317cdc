"""Continuous ingest: files or page texts that arrive become chunks, each micro-batch by the same plan as a whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docspring.config import Settings
from docspring.operators import chunking
from docspring.schemas import PAGES
from docspring.sources.segments import SegmentedTerms


def page_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Page texts (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def stream_chunks(pages: DataFrame, out: str, checkpoint: str, settings: Settings, once: bool = False, terms: str | None = None) -> StreamingQuery:
    """Chunks of each micro-batch, under the number of their batch: a batch that is repeated replaces its own files, so every
    page is written once. A document's pages must arrive in one batch. With `terms`, the term index under that path grows by
    each batch; a document that comes again replaces what it had there, and a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        made = chunking.page_chunks(batch, settings.chunk_size, settings.chunk_overlap)
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if terms is not None:
            session = batch.sparkSession
            SegmentedTerms(session, terms).upsert(session.read.parquet(f"{out}/batch={number}"))

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
