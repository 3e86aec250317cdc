"""Untrusted payload fields, held as VARIANT, to numbers that are safe to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspring.functions.text import col

CAP, LIMIT = 500_000, 1e9


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def strict_uint(v: Column | str, fallback: int = 0, cap: int = CAP) -> Column:
    """A whole number from 0 to cap (within 1e-9), given as a number; everything else is the fallback."""
    v = col(v)
    x = F.try_variant_get(v, "$", "double")
    whole = F.round(x)
    number = ~_kind(v).isin("BOOLEAN", "STRING", "VOID") & ~_kind(v).startswith("OBJECT") & ~_kind(v).startswith("ARRAY")
    good = v.isNotNull() & number & ~F.isnan(x) & (F.abs(x - whole) <= 1e-9) & (whole >= 0) & (whole <= cap)
    return F.when(good, whole.cast("long")).otherwise(F.lit(fallback).cast("long"))


def strict_float(v: Column | str, fallback: float = 0.0) -> Column:
    """A finite number (also given as text), clipped to plus or minus 1e9."""
    v = col(v)
    x = F.try_variant_get(v, "$", "double")
    bad = v.isNull() | (_kind(v) == "BOOLEAN") | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(fallback)).otherwise(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x)))


def patch_placement(payload: Column | str) -> Column:
    """struct of a patch's indices and sizes; sizes are at least 1."""
    p = col(payload)
    field = lambda name: F.try_variant_get(p, f"$.{name}", "variant")
    indices = [strict_uint(field(n)).alias(n) for n in ("page_index", "row_index", "col_index", "x0_px", "y0_px")]
    sizes = [F.greatest(F.lit(1).cast("long"), strict_uint(field(n), 1)).alias(n) for n in ("width_px", "height_px", "pixmap_page_width", "pixmap_page_height")]
    return F.struct(*indices, *sizes)
