"""Patch grids and their placement on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspring.functions.text import col

LEAST_PATCH, LEAST_STRIDE = 64, 16


def check_grid(patch: int, stride: int) -> None:
    if patch < LEAST_PATCH or stride < LEAST_STRIDE or stride > patch:
        raise ValueError(f"patch {patch} and stride {stride} make no grid")


def patch_grid(width: Column | str, height: Column | str, patch: int, stride: int) -> Column:
    """array of struct(row_index, col_index, x0_px, y0_px, width_px, height_px), row by row; tiles at the edge are clipped."""
    check_grid(patch, stride)
    w, h = col(width), col(height)
    across, down = (F.sequence(F.lit(0), F.greatest(x - 1, F.lit(0)), F.lit(stride)) for x in (w, h))
    tile = lambda x, i, y, j: F.struct(j.alias("row_index"), i.alias("col_index"), x.alias("x0_px"), y.alias("y0_px"), F.least(F.lit(patch), w - x).alias("width_px"), F.least(F.lit(patch), h - y).alias("height_px"))
    rows = F.transform(down, lambda y, j: F.transform(across, lambda x, i: tile(x, i, y, j)))
    return F.flatten(rows)


def patch_count(width: Column | str, height: Column | str, patch: int, stride: int) -> Column:
    check_grid(patch, stride)
    return (F.ceil(col(width) / stride) * F.ceil(col(height) / stride)).cast("long")


def pdf_rect(page_x0: Column, page_y0: Column, page_x1: Column, page_y1: Column, pixmap_width: Column, pixmap_height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x0, y0, x1, y1): a tile's place in the page's own units."""
    sx = (page_x1 - page_x0) / F.greatest(pixmap_width, F.lit(1))
    sy = (page_y1 - page_y0) / F.greatest(pixmap_height, F.lit(1))
    return F.struct((page_x0 + x * sx).alias("x0"), (page_y0 + y * sy).alias("y0"), (page_x0 + (x + w) * sx).alias("x1"), (page_y0 + (y + h) * sy).alias("y1"))
