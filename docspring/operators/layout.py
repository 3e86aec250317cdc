"""Reading order, neighbours of anchors on a page, and duplicates of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspring.functions import text

SLACK = 2.0
SNIPPET = 400
INF = float("inf")


def page_spans(pages: DataFrame) -> DataFrame:
    """One span without a box for each page that isn't blank."""
    return pages.where(text.strip("text") != "").select("doc_id", F.concat(F.lit("pypdf-page-"), F.col("page_index").cast("string")).alias("span_id"), "page_index", *(F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "text", F.lit("pypdf").alias("extractor"))


def reading_order(spans: DataFrame) -> DataFrame:
    """With reading_no from 1 in each document: page, top, left, then the id as text; spans without a box last on their page."""
    keys = ["page_index", F.coalesce("y0", F.lit(INF)), F.coalesce("x0", F.lit(INF)), "span_id"]
    return spans.withColumn("reading_no", F.row_number().over(W.partitionBy("doc_id").orderBy(*keys)).cast("long"))


def nearest_neighbors(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """anchors (doc_id, anchor_id, page_index, y0, y1) with above_id and below_id: the spans of the page with the least gap.

    A span is above if its bottom is at most SLACK below the anchor's top, and the other way round; the gap may be negative.
    Ties go to the first in span_pos. Left and right don't matter.

    A sweep: the edges of a page's anchors and spans are put in one order, and each anchor takes the best of the spans that it
    has passed. So a page costs a sort, not all pairs of its anchors and spans.
    """
    kind, none = dict(anchors.dtypes), F.lit(None)
    anchor = lambda edge: anchors.select("doc_id", "page_index", F.col("anchor_id"), edge.alias("edge"), F.lit(1).alias("turn"), none.cast("double").alias("at"), none.cast(dict(spans.dtypes)["span_pos"]).alias("pos"), none.cast(dict(spans.dtypes)["span_id"]).alias("id"))
    boxed = spans.where("y0 is not null and y1 is not null")
    span = lambda edge: boxed.select("doc_id", "page_index", none.cast(kind["anchor_id"]).alias("anchor_id"), F.col(edge).alias("edge"), F.lit(0).alias("turn"), F.col(edge).cast("double").alias("at"), F.col("span_pos").alias("pos"), F.col("span_id").alias("id"))

    def swept(rows: DataFrame, down: bool, name: str) -> DataFrame:
        # downwards, the lowest bottom passed so far; upwards, the highest top; an anchor comes after spans on its edge
        order = W.partitionBy("doc_id", "page_index").orderBy(F.asc("edge") if down else F.desc("edge"), "turn")
        passed = F.when(F.col("turn") == 0, F.struct((-F.col("at") if down else F.col("at")).alias("at"), "pos", "id"))
        best = F.min(passed).over(order.rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("best", best).where("turn = 1").groupBy("doc_id", "page_index", "anchor_id").agg(F.min("best")["id"].alias(name))

    top, bottom = F.col("y0") + SLACK, F.col("y1") - SLACK
    above = swept(anchor(top).unionByName(span("y1")), True, "above_id")
    below = swept(anchor(bottom).unionByName(span("y0")), False, "below_id")
    return above.join(below, ["doc_id", "page_index", "anchor_id"])


def with_page_fallback(anchors: DataFrame, spans: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Anchors without a box get the page's first span as above, and its last as below if the page has more than one."""
    ordered = reading_order(spans.where("y0 is not null"))
    pages = ordered.groupBy("doc_id", "page_index").agg(F.min_by("span_id", "reading_no").alias("first_id"), F.max_by("span_id", "reading_no").alias("last_id"), F.count(F.lit(1)).alias("n"))
    bare = anchors.where("y0 is null").join(pages, ["doc_id", "page_index"], "left")
    bare = bare.select("doc_id", "page_index", "anchor_id", F.col("first_id").alias("above_id"), F.when(F.col("n") > 1, F.col("last_id")).alias("below_id"))
    boxed = neighbors.join(anchors.where("y0 is not null").select("doc_id", "anchor_id"), ["doc_id", "anchor_id"], "left_semi")
    return boxed.unionByName(bare)


def neighbor_snippets(neighbors: DataFrame, spans: DataFrame, most: int = SNIPPET) -> DataFrame:
    """With the neighbours' texts, clipped."""
    out = neighbors
    for side in ("above", "below"):
        texts = spans.select("doc_id", F.col("span_id").alias(f"{side}_id"), text.clip("text", most, nul=False).alias(f"contextual_snippet_{side}"))
        out = out.join(texts, ["doc_id", f"{side}_id"], "left")
    return out


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def distinct_images(images: DataFrame) -> DataFrame:
    return first_of(images, ["doc_id", "page_index", "xref", "x0", "y0", "x1", "y1"], ["page_index", "xref", "y0", "image_pos"])


def distinct_tables(tables: DataFrame) -> DataFrame:
    """By cells and page, lattice before stream."""
    cells = F.sha2(F.to_json("rows"), 256)
    return first_of(tables.withColumn("__cells", cells), ["doc_id", "page_index", "__cells"], ["flavor_rank", "table_pos"]).drop("__cells")


def labelled_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with a numbered figure in the snippets around them, and notes on the others."""
    cue = text.has_figure_cue("contextual_snippet_above", "contextual_snippet_below")
    note = F.concat(F.lit("image without figure label: xref "), F.col("xref").cast("string"))
    return images.where(cue), images.where(~cue).select("doc_id", F.lit("images").alias("stage"), note.alias("note"))
