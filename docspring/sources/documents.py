"""Files to bronze and silver tables. Parsers are pluggable batch functions over bytes; what fails becomes a note, not an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspring.schemas import IMAGES, NOTES, PAGES, SPANS, TABLES
from docspring.staging import Staging

GOLD = {"Question": "question", "Ground_Truth_Context": "ground_truth_context", "Ground_Truth_Answer": "ground_truth_answer", "Page_Number": "page_number", "Context_Content_Type": "context_content_type"}


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (digest of the bytes), path, content: one row for each file, read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("doc_id"), "path", "content", "length")


def safe_primitive(x: object) -> str:
    """Metadata values as text: bytes decoded, times in ISO form."""
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    return x.isoformat() if isinstance(x, datetime | date) else str(x)


def clean_metadata(raw: dict) -> dict[str, str]:
    return {str(k).lstrip("/"): safe_primitive(v) for k, v in raw.items()}


def parsed(files: DataFrame, parser: Callable[[str, bytes], Iterator[dict]], schema: str, stage: str, staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that a parser makes of each file, and notes on files that it failed on. A parser takes doc_id and bytes; Arrow batches
    hold some 64 MB of files (spark.sql.execution.arrow.maxBytesPerBatch). With a staging folder its output is written once, and
    rows and notes are read from there; without one each of their readers runs the parser."""
    full = T.StructType.fromDDL(f"{schema}, __note string")
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out = [{"doc_id": doc_id, **row} for row in parser(doc_id, content)]
                except Exception as e:  # one bad file costs its rows only
                    out = [{"doc_id": doc_id, "__note": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    rows = files.select("doc_id", "content").mapInArrow(run, full)
    if staging is not None:
        rows = staging.stored(rows, stage)
    return rows.where("__note is null").drop("__note"), rows.where("__note is not null").select("doc_id", F.lit(stage).alias("stage"), F.col("__note").alias("note"))


def page_texts(files: DataFrame, parser: Callable[[str, bytes], Iterator[dict]], staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    return parsed(files, parser, PAGES, "pages", staging)


def layout_spans(files: DataFrame, parser: Callable[[str, bytes], Iterator[dict]], staging: Staging | None = None, page_heights: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Boxes with their origin at the bottom left are turned over if the pages' heights are given."""
    spans, notes = parsed(files, parser, SPANS, "spans", staging)
    if page_heights is not None:
        spans = spans.withColumns({"y0": page_heights - F.col("y1"), "y1": page_heights - F.col("y0")})
    return spans, notes


def markdown_span(files: DataFrame, parser: Callable[[str, bytes], Iterator[dict]], staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    """A document's Markdown as one span without a box on page 0; it takes no part in the layout."""
    return parsed(files, parser, SPANS, "markdown", staging)


def table_blocks(files: DataFrame, parser: Callable[[str, bytes], Iterator[dict]], staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    """Table ids are counted within a page, so a repeated task gives the same ones."""
    return parsed(files, parser, TABLES, "tables", staging)


def image_blocks(files: DataFrame, parser: Callable[[str, bytes], Iterator[dict]], staging: Staging | None = None) -> tuple[DataFrame, DataFrame]:
    return parsed(files, parser, IMAGES, "images", staging)


def empty_notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NOTES)


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from CSV: all columns as text, stripped, empty instead of null; blank questions are dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    missing = [c for c in GOLD if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    return raw.select(*(strip(c).alias(name) for c, name in GOLD.items())).where("question <> ''")
