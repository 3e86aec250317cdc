"""Tables and images as searchable chunks, and exports of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import ids, text

MOST, PREVIEW, NEAR, SNIPPET, SECTION, ROWS = 12_000, 6_000, 400, 1_200, 240, 80
MIN_AREA = 8192


def line_of(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def rows_markdown(rows: Column | str, most: int = ROWS) -> Column:
    """array<array<string>> as a Markdown table, the first row as its head."""
    cells = F.transform(F.slice(text.col(rows), 1, most), lambda r: F.transform(r, lambda c: text.strip(F.coalesce(c, F.lit("")))))
    lines = F.flatten(F.transform(cells, lambda r, i: F.when(i == 0, F.array(line_of(r), line_of(F.transform(r, lambda _: F.lit("---"))))).otherwise(F.array(line_of(r)))))
    return F.array_join(lines, "\n")


def _full(c: str) -> Column:
    return F.nullif(text.strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def table_chunks(tables: DataFrame, most: int = MOST, preview: int = PREVIEW) -> DataFrame:
    """One chunk for each table with a body: Markdown, else CSV, else its first rows. tables has pdf_sha256, source and n."""
    body = F.substring(F.coalesce(_full("as_markdown"), _full("as_csv"), F.when(F.size("rows") > 0, rows_markdown("rows")), F.lit("")), 1, most)
    page = (F.col("page_index") + 1).cast("string")
    near = _full("contextual_snippet_above")
    head = F.array_join(F.array_compact(F.array(F.concat(F.lit("TABLE · page "), page, F.lit(" · "), F.col("extractor")), F.concat(F.lit("table_id="), F.col("table_id")), F.concat(F.lit("Summary: "), _full("summary")), F.concat(F.lit("Nearby text (above): "), F.substring(near, 1, NEAR)))), "\n")
    summary = _full("summary")
    out = tables.withColumn("__body", body).where("__body <> ''")
    return out.select(
        "doc_id", "n", ids.table_chunk_id("pdf_sha256", "table_id", "page_index").alias("chunk_id"), F.substring(text.strip(F.concat(head, F.lit("\n\n"), F.col("__body"))), 1, most).alias("text"),
        F.col("page_index").alias("page_start"), F.col("page_index").alias("page_end"), "source", F.concat(F.lit("pdf_table:"), F.col("extractor")).alias("structure_note"), F.lit("table_structured").alias("content_type"),
        F.coalesce(F.substring(F.get(F.split(summary, "\n"), F.lit(0)), 1, SECTION), F.concat(F.lit("page "), page)).alias("section_hint"), F.lit("pdf_table").alias("chunk_kind"), "table_id",
        F.substring(_full("as_csv"), 1, preview).alias("table_csv_preview"), F.lit(None).cast("bigint").alias("image_xref"),
    )


def image_area() -> Column:
    """Width times height in pixels if both are given and not 0, else the box's area, cut to a whole number."""
    px = F.greatest(F.col("width_px").cast("long") * F.col("height_px"), F.lit(0))
    box = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    return F.when((F.coalesce("width_px", F.lit(0)) != 0) & (F.coalesce("height_px", F.lit(0)) != 0), px).otherwise(box.cast("long"))


def indexed_images(images: DataFrame, min_area: int = MIN_AREA) -> DataFrame:
    """Images with a caption or a snippet; small ones only with a caption."""
    caption = _full("caption")
    some = caption.isNotNull() | _full("contextual_snippet_above").isNotNull() | _full("contextual_snippet_below").isNotNull()
    return images.where(some & ((image_area() >= min_area) | caption.isNotNull()))


def image_chunks(images: DataFrame, min_area: int = MIN_AREA, most: int = MOST, need_label: bool = False) -> DataFrame:
    """One chunk for each image that is indexed. images has pdf_sha256, source and n."""
    if need_label:
        images = images.where(text.has_figure_cue("contextual_snippet_above", "contextual_snippet_below", "caption"))
    caption, above, below = _full("caption"), _full("contextual_snippet_above"), _full("contextual_snippet_below")
    page = (F.col("page_index") + 1).cast("string")
    number = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("?"))
    first = F.concat(F.lit("FIGURE · page "), page, F.lit(" · xref "), F.col("xref").cast("string"), F.lit(" · "), F.coalesce(F.nullif(F.col("mime_type"), F.lit("")), F.lit("image")))
    size = F.concat(F.lit("Approximate size: "), number("width_px"), F.lit("×"), number("height_px"), F.lit("px (area ≈ "), image_area().cast("string"), F.lit(")"))
    seen = F.concat(F.lit("Visual description (model: "), F.coalesce(F.nullif(F.col("caption_model"), F.lit("")), F.lit("unknown")), F.lit("):\n"), caption)
    parts = [first, size, seen, F.concat(F.lit("Nearby document text (above figure): "), F.substring(above, 1, SNIPPET)), F.concat(F.lit("Nearby document text (below figure): "), F.substring(below, 1, SNIPPET))]
    return indexed_images(images, min_area).select(
        "doc_id", "n", ids.image_chunk_id("pdf_sha256", "xref", "page_index").alias("chunk_id"), F.substring(text.strip(F.array_join(F.array_compact(F.array(*parts)), "\n\n")), 1, most).alias("text"),
        F.col("page_index").alias("page_start"), F.col("page_index").alias("page_end"), "source", F.lit("pdf_image:pymupdf").alias("structure_note"), F.lit("figure_visual").alias("content_type"),
        F.coalesce(F.substring(F.get(F.split(caption, "\n"), F.lit(0)), 1, SECTION), F.concat(F.lit("figure page "), page)).alias("section_hint"), F.lit("pdf_image").alias("chunk_kind"),
        F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("string").alias("table_csv_preview"), F.col("xref").cast("bigint").alias("image_xref"),
    )


def unique_names(head: Column | str) -> Column:
    """Repeats of a name that isn't empty get .1, .2 and so on; "Year, Year" is "Year, Year.1"."""
    head = F.transform(text.col(head), lambda c: F.coalesce(c, F.lit("")))
    before = lambda c, i: F.size(F.filter(F.slice(head, F.lit(1), i), lambda x: x == c))
    return F.transform(head, lambda c, i: F.when((c == "") | (before(c, i) == 0), c).otherwise(F.concat(c, F.lit("."), before(c, i).cast("string"))))


def csv_field(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\r\n]'), quoted).otherwise(c)


def html_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def table_exports(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """With as_markdown, as_csv, as_html and as_json; the first row names the columns. Null where there are no data rows."""
    cells = F.transform(F.col(rows), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    out = tables.withColumn("__rows", cells).withColumn("__head", unique_names(F.get("__rows", F.lit(0)))).withColumn("__data", F.slice("__rows", 2, 1 << 30))
    some = F.size("__data") > 0
    every = F.concat(F.array("__head"), F.col("__data"))
    csv = F.concat(F.array_join(F.transform(every, lambda r: F.array_join(F.transform(r, csv_field), ",")), "\n"), F.lit("\n"))
    tag = lambda r, t: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{t}>"), html_text(c), F.lit(f"</{t}>"))), ""), F.lit("</tr>"))
    html = F.concat(F.lit("<table>"), tag(F.col("__head"), "th"), F.array_join(F.transform("__data", lambda r: tag(r, "td")), ""), F.lit("</table>"))
    records = F.transform("__data", lambda r: F.map_from_arrays(F.transform("__head", lambda h, i: F.when(h == "", F.concat(F.lit("#"), i.cast("string"))).otherwise(h)), r))
    return out.withColumns({"as_markdown": F.when(some, rows_markdown(every)), "as_csv": F.when(some, csv), "as_html": F.when(some, html), "as_json": F.when(some, F.to_json(records))}).drop("__rows", "__head", "__data")


def numeric_columns(cells: DataFrame) -> DataFrame:
    """table_id, column of the columns to chart, from (table_id, column, row_no, value as text).

    Columns in which every value that isn't empty parses as a number; if a table has none, those in which at least half of
    the rows (two at least) parse.
    """
    number, full = F.col("value").try_cast("double"), F.nullif(F.trim("value"), F.lit("")).isNotNull()
    stats = cells.groupBy("table_id", "column").agg(F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("full"), F.count_if(number.isNotNull()).alias("numbers"))
    whole = (F.col("numbers") > 0) & (F.col("numbers") == F.col("full"))
    any_whole = F.max(whole.cast("int")).over(W.partitionBy("table_id")) == 1
    half = F.col("numbers") >= F.greatest(F.lit(2), F.floor(F.col("rows") * 0.5))
    return stats.withColumn("keep", F.when(any_whole, whole).otherwise(half)).where("keep").select("table_id", "column", "rows", "numbers")
