"""Page texts and layout spans to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import ids, text
from docspring.operators.layout import reading_order
from docspring.staging import Staging

JOIN = 2  # characters between joined pages or spans
WINDOWS = 64  # neighbouring windows that are put together in one row


def constructed(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, n, text, page_start, page_end, source, structure_note) as chunks; n orders them within a document."""
    out = rows.withColumns({
        "chunk_id": ids.chunk_id("text", "page_start", "page_end", "source"),
        "content_type": text.content_type("text", "structure_note"),
        "section_hint": text.section_hint("text"),
        "chunk_kind": F.lit("narrative"),
    })
    nothing = {"table_id": "string", "table_csv_preview": "string", "image_xref": "bigint"}
    return out.withColumns({k: F.lit(None).cast(v) for k, v in nothing.items()})


def page_chunks(pages: DataFrame, size: int = 1200, overlap: int = 200, source: Column | None = None) -> DataFrame:
    """Windows over a document's pages (doc_id, page_index, text), joined by two characters.

    A chunk's page is the last that begins at or before its middle character. Blank pages take no part. Pages are cut where
    windows begin, into pieces that know their place and page; WINDOWS neighbouring windows are put together in one row, which
    holds the pieces of the page that each one's middle lies in. No row holds more of a document than that and no join is
    needed, so a document may have any number of pages.
    """
    step = text.window_step(size, overlap)
    reach = -(-size // step)  # pieces' cells that a window covers
    full = pages.select("doc_id", "page_index", text.clean_text("text").alias("text")).where("text <> ''")
    order = W.partitionBy("doc_id").orderBy("page_index")
    start = F.coalesce(F.sum(F.length("text").cast("long") + JOIN).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    last = F.lead("page_index").over(order).isNull()
    placed = full.select("doc_id", "page_index", start.alias("start"), F.when(last, F.col("text")).otherwise(F.concat("text", F.lit("\n\n"))).alias("text"))
    head = F.lit(step) - F.pmod("start", F.lit(step))
    cells = F.concat(F.array(F.substr("text", F.lit(1), head)), F.regexp_extract_all(F.substr("text", head + 1), F.lit(f"(?s)(.{{1,{step}}})"), 1))
    cut = placed.select("doc_id", "page_index", "start", F.floor(F.col("start") / step).alias("first"), F.posexplode(cells).alias("i", "t"))
    cell = F.col("first") + F.col("i")
    pieces = cut.select("doc_id", cell.alias("cell"), F.greatest("start", cell * step).alias("at"), F.col("page_index").alias("page"), "t")
    block = lambda c: F.floor(c / WINDOWS)
    spread = pieces.withColumn("block", F.explode(F.array_distinct(F.array(block(F.greatest(F.col("cell") - reach + 1, F.lit(0))), block(F.col("cell"))))))
    held = spread.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "cell", "page", "t"))).alias("p"))

    def window(n: Column) -> Column:
        inside = F.filter("p", lambda x: (x["cell"] >= n) & (x["cell"] < n + reach))
        whole = F.substring(F.array_join(F.transform(inside, lambda x: x["t"]), ""), 1, size)
        page = F.element_at(F.filter(inside, lambda x: x["at"] <= n * step + F.floor(F.length(whole) / 2)), -1)["page"]
        return F.struct(n.cast("int").alias("n"), whole.alias("text"), page.alias("page"))

    first, end = F.col("block") * WINDOWS, F.least(F.col("block") * WINDOWS + WINDOWS - 1, F.element_at("p", -1)["cell"])
    # a block that holds only the beginning of the next one's first window has no window of its own beyond its last cell
    made = held.where(end >= first).select("doc_id", F.explode(F.transform(F.sequence(first, end), window)).alias("w"))
    src = source if source is not None else F.col("doc_id").cast("string")
    rows = made.select("doc_id", "w.n", text.strip("w.text").alias("text"), F.col("w.page").alias("page_start"), F.col("w.page").alias("page_end"), src.alias("source"), F.lit("pypdf_page_window").alias("structure_note"))
    return constructed(rows.where("text <> ''"))


def layout_runs(spans: DataFrame, size: int = 1200) -> DataFrame:
    """doc_id, run, text, page_start, page_end: spans in reading order, merged greedily.

    A run ends before the span with which it would be longer than `size` (two characters between spans); one span that is
    longer by itself is a run. Lengths are those of the cleaned texts. The fold holds a counter for each document and sees
    lengths alone, so documents of any length stream.
    """
    ordered = reading_order(spans.withColumn("text", text.clean_text("text")).where("text <> ''")).select("doc_id", "reading_no", "page_index", "text")
    groups = ordered.select("doc_id", "reading_no", F.length("text").alias("n")).repartition("doc_id").sortWithinPartitions("doc_id", "reading_no")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, used, run = object(), 0, 0
        for batch in batches:
            runs = []
            for d, n in zip(batch["doc_id"], batch["n"], strict=True):
                if d != doc:
                    doc, used, run = d, 0, 0
                elif used + JOIN + n > size:
                    used, run = 0, run + 1
                used += n + (JOIN if used else 0)
                runs.append(run)
            yield batch.assign(run=runs).drop(columns="n")

    kind = dict(spans.dtypes)["doc_id"]
    numbered = ordered.join(groups.mapInPandas(fold, f"doc_id {kind}, reading_no long, run long"), ["doc_id", "reading_no"])
    parts = F.array_sort(F.collect_list(F.struct("reading_no", "text")))
    return numbered.groupBy("doc_id", "run").agg(text.clean_text(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")).alias("text"), F.min("page_index").alias("page_start"), F.max("page_index").alias("page_end"))


def layout_chunks(spans: DataFrame, size: int = 1200, overlap: int = 200, source: Column | None = None) -> DataFrame:
    """Windows over the runs of a document's spans."""
    cut = layout_runs(spans, size).select("doc_id", "run", "page_start", "page_end", F.posexplode(text.windows("text", size, overlap)).alias("k", "w"))
    numbered = cut.withColumn("n", (F.row_number().over(W.partitionBy("doc_id").orderBy("run", "k")) - 1).cast("int"))
    src = source if source is not None else F.col("doc_id").cast("string")
    rows = numbered.select("doc_id", "n", text.strip("w.text").alias("text"), "page_start", "page_end", src.alias("source"), F.lit("layout_reading_order").alias("structure_note"))
    return constructed(rows.where("text <> ''"))


def narrative_chunks(spans: DataFrame, pages: DataFrame, size: int = 1200, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Layout chunks, and page windows for the documents that have none; with notes on those."""
    by_layout = layout_chunks(spans, size, overlap)
    rest = pages.join(by_layout.select("doc_id").distinct(), "doc_id", "left_anti")
    notes = rest.select("doc_id").distinct().select("doc_id", F.lit("chunking").alias("stage"), F.lit("layout_chunking_empty_fallback_to_pypdf_pages").alias("note"))
    return by_layout.unionByName(page_chunks(rest, size, overlap)), notes


def union_chunks(narrative: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None, staging: Staging | None = None) -> DataFrame:
    """Narrative chunks, then tables, then images, with chunk_pos as the corpus order, by kind, document and number."""
    out = narrative.withColumn("kind_no", F.lit(0))
    for k, more in enumerate((tables, images), 1):
        if more is not None:
            out = out.unionByName(more.withColumn("kind_no", F.lit(k)), allowMissingColumns=True)
    return positioned(out, ["kind_no", "doc_id", "n"], staging=staging).drop("kind_no")


def positioned(df: DataFrame, keys: list[str], name: str = "chunk_pos", staging: Staging | None = None) -> DataFrame:
    """With a dense number from 0 by these keys.

    Rows are written once in sorted range partitions, each with its partition and its place there. Counts come from that
    table, so what is counted is what is numbered; the partitions' beginnings are as many rows as there are write tasks.
    The table stays for as long as the result is read: give a staging folder to delete it.
    """
    spark, place = df.sparkSession, "__place"
    table = staging or Staging(spark, "positions")
    written = table.stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id()), f"by-{name}")
    part, at = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))  # how Spark makes these ids
    starts, total = [], 0
    for r in written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).orderBy("part").collect():
        if r.last != r.n - 1:
            raise RuntimeError(f"partition {r.part} has {r.n} rows and the place {r.last}")
        starts.append((r.part, total))
        total += r.n
    begins = spark.createDataFrame(starts, "__part long, __start long")
    joined = written.withColumn("__part", part).join(F.broadcast(begins), "__part", "left")
    start = F.coalesce("__start", F.raise_error(F.concat(F.lit("no beginning of partition "), F.col("__part").cast("string"))).cast("long"))
    return joined.withColumn(name, start + at).drop("__part", "__start", place)


def payload(chunks: DataFrame) -> DataFrame:
    """The text, and its eleven metadata fields in one struct."""
    fields = "chunk_id page_start page_end source structure_note content_type section_hint chunk_kind table_id table_csv_preview image_xref"
    return chunks.select("text", F.struct(*fields.split()).alias("metadata"))


def status(tables: DataFrame) -> str:
    return "narrative_only" if tables.isEmpty() else "merged"
