"""Tables found in text alone: rows by overlap in height, columns by gaps in the projection, cells by the column they overlap most.

Everything is a plan over spans (doc_id, page_index, span_id, x0, y0, x1, y1, text); windows and groups are pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import text as words

PAGE = ["doc_id", "page_index"]
#: Part of a span's height at top and bottom that may overlap another row, and the gap between two cells of a row.
EDGE, GAP = 0.25, 6.0
#: Space between two rows of a table, in heights of the lower one.
ROW_SPACE = 2.0
LEAST_ROWS, LEAST_COLUMNS = 2, 2


def islands(df: DataFrame, keys: list[str], lo: str, hi: str, name: str, gap: float = 0.0) -> DataFrame:
    """With the number (from 0) of the run of intervals that each belongs to: one begins where no earlier one reaches to within
    `gap`."""
    order = W.partitionBy(*keys).orderBy(lo, hi, "span_id")
    reach = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = df.withColumn("__new", F.when(F.col(lo) < reach + gap, 0).otherwise(1))
    return begun.withColumn(name, (F.sum("__new").over(order) - 1).cast("int")).drop("__new")


def placed(spans: DataFrame, gap: float = GAP) -> DataFrame:
    """Spans with a box and a text, with row_no within their page and cell_no within their row."""
    full = spans.where("x0 is not null and y0 is not null and x1 > x0 and y1 > y0").withColumn("text", words.clean_text("text")).where("text <> ''")
    edge = (F.col("y1") - F.col("y0")) * EDGE
    rows = islands(full.withColumns({"__top": F.col("y0") + edge, "__bottom": F.col("y1") - edge}), PAGE, "__top", "__bottom", "row_no").drop("__top", "__bottom")
    return islands(rows, [*PAGE, "row_no"], "x0", "x1", "cell_no", gap)


def runs_of_rows(cells: DataFrame, row_space: float = ROW_SPACE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, page_index, row_no, table_no, cells and most (the most cells of a row of the table): neighbouring rows of two cells
    or more, without much space in between."""
    rows = cells.groupBy(*PAGE, "row_no").agg((F.max("cell_no") + 1).alias("cells"), F.min("y0").alias("top"), F.max("y1").alias("bottom")).where(F.col("cells") >= LEAST_COLUMNS)
    order = W.partitionBy(*PAGE).orderBy("row_no")
    near = (F.lag("row_no").over(order) == F.col("row_no") - 1) & (F.col("top") - F.lag("bottom").over(order) <= row_space * (F.col("bottom") - F.col("top")))
    held = rows.withColumn("__new", F.when(near, 0).otherwise(1)).withColumn("table_no", (F.sum("__new").over(order) - 1).cast("int"))
    table = W.partitionBy(*PAGE, "table_no")
    return held.withColumns({"most": F.max("cells").over(table), "__n": F.count(F.lit(1)).over(table)}).where(F.col("__n") >= least_rows).select(*PAGE, "row_no", "table_no", "cells", "most")


def columns_of(cells: DataFrame, least_columns: int = LEAST_COLUMNS) -> DataFrame:
    """doc_id, page_index, table_no, column_no, lo and hi: gaps in the projection of a table's fullest rows. A head that spans
    columns has fewer cells, so it doesn't close their gaps."""
    table = [*PAGE, "table_no"]
    found = islands(cells.where("cells = most"), table, "x0", "x1", "column_no").groupBy(*table, "column_no").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    return found.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*table))).where(F.col("__n") >= least_columns).withColumnRenamed("__n", "columns")


def table_cells(spans: DataFrame, gap: float = GAP, row_space: float = ROW_SPACE) -> DataFrame:
    """doc_id, page_index, table_no, row_no (within the table), column_no, columns, text and box of each cell that has a text."""
    cells = placed(spans, gap)
    cells = cells.join(runs_of_rows(cells, row_space), [*PAGE, "row_no"])
    table = [*PAGE, "table_no"]
    # an interval join within the table: the column of the greatest overlap, of none the nearest, of equal ones the first
    shared = F.least("x1", "hi") - F.greatest("x0", "lo")
    best = cells.join(columns_of(cells), table).groupBy(*table, "row_no", "cell_no", "span_id").agg(F.max_by("column_no", F.struct(shared, -F.col("column_no"))).alias("column_no"), *(F.first(c).alias(c) for c in ("columns", "x0", "y0", "x1", "y1", "text")))
    parts = F.array_sort(F.collect_list(F.struct("x0", "y0", "span_id", "text")))
    made = best.groupBy(*table, "row_no", "column_no", "columns").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return made.withColumn("row_no", (F.col("row_no") - F.min("row_no").over(W.partitionBy(*table))).cast("int"))


def stream_tables(spans: DataFrame, gap: float = GAP, row_space: float = ROW_SPACE) -> DataFrame:
    """Table blocks: doc_id, page_index, table_pos, table_id, rows (every row as long as the table is wide), filled (the share of
    cells with a text) and the box. Ids are made of document, page and number, so a repeated run gives the same ones."""
    cells = table_cells(spans, gap, row_space)
    table = [*PAGE, "table_no"]
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    held = F.map_from_entries(F.collect_list(F.struct(F.struct("row_no", "column_no").alias("at"), "text")))  # of one page
    whole = cells.groupBy(*table).agg(held.alias("m"), (F.max("row_no") + 1).alias("n"), F.first("columns").cast("int").alias("columns"), *box)
    at = lambda i, j: F.coalesce(F.col("m")[F.struct(i.alias("row_no"), j.alias("column_no"))], F.lit(""))
    rows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: at(i, j)))
    name = F.concat(F.lit("stream-p"), F.col("page_index").cast("string"), F.lit("-"), F.col("table_no").cast("string"))
    return whole.select(*PAGE, F.col("table_no").cast("long").alias("table_pos"), name.alias("table_id"), rows.alias("rows"), (F.size(F.map_keys("m")) / (F.col("n") * F.col("columns"))).alias("filled"), "x0", "y0", "x1", "y1", F.lit("text_stream").alias("extractor"))
