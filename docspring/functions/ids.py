"""Content hashes and identifiers as Column expressions."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspring.functions.text import col

#: Fixed value: the namespace of URLs in version 5 identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
LENGTH = 24


def digest(*parts: Column, length: int = LENGTH) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, length)


def chunk_id(text: Column | str, page_start: Column | str, page_end: Column | str, source: Column | str) -> Column:
    tail = [x for c in (page_start, page_end, source) for x in (F.lit("|"), col(c).cast("string"))]
    return digest(col(text), *tail)


def table_chunk_id(pdf: Column | str, table_id: Column | str, page: Column | str) -> Column:
    return digest(col(pdf), F.lit("\0"), col(table_id), F.lit("\0"), col(page).cast("string"))


def image_chunk_id(pdf: Column | str, xref: Column | str, page: Column | str) -> Column:
    return digest(col(pdf), F.lit("\0img\0"), col(xref).cast("string"), F.lit("\0"), col(page).cast("string"))


def patch_id(pdf: Column | str, page: Column | str, row: Column | str, column: Column | str, dpi: Column | str) -> Column:
    parts = [F.lit("|p="), col(page).cast("string"), F.lit("|r="), col(row).cast("string"), F.lit("|c="), col(column).cast("string"), F.lit("|dpi="), col(dpi).cast("double").cast("string")]
    return F.concat(F.lit("p6-"), digest(col(pdf), *parts, length=26))


def point_uuid(chunk: Column | str) -> Column:
    """Version 5 identifier of "rag:<chunk id>" among URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.concat(F.lit("rag:"), col(chunk)).cast("binary")))
    ninth = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), F.lower(F.hex(ninth)), cut(19, 2), F.lit("-"), cut(21, 12))


def corpus_digest(index_path: str, collection: str) -> str:
    return hashlib.sha256(f"{os.path.realpath(index_path)}\0{collection}".encode()).hexdigest()[:16]


def cache_paths(template: str, index_path: str, collection: Column | str) -> Column:
    """The same as cache_path() for a column of collections."""
    d = F.substring(F.sha2(F.concat(F.lit(os.path.realpath(index_path)), F.lit("\0"), col(collection)), 256), 1, 16)
    return F.concat(F.lit(template[:-5] + "_"), d, F.lit(".json")) if template.endswith(".json") else F.concat(F.lit(os.path.join(template, "")), d)


def cache_path(template: str, index_path: str, collection: str) -> str:
    """One answer cache for each corpus: <stem>_<digest>.json, or a folder of that name."""
    d = corpus_digest(index_path, collection)
    return f"{template[:-5]}_{d}.json" if template.endswith(".json") else os.path.join(template, d)
