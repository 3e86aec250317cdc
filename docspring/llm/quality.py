"""Quality rules (3): measures of each text, and the frequency of its lines across the documents of its host.

A line's key is a hash of the line in lower case, with single spaces and every digit as 0. A line in more distinct texts of
one host than its limit is taken out there, and a document that little is left of is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspring.llm.common import IS_SPACE, Scratch, as_bytes, covered, mix, slices, trimmed, windows_of, words_of

#: A line is taken out of a host's documents if more distinct texts hold it than both of these.
LIMIT_TEXTS = 20
LIMIT_SHARE = 0.1
#: A document is depleted with fewer words left, or with less than this share of its words left.
LEAST_WORDS = 20
LEAST_SHARE = 0.5
REPEAT_WINDOW = 8

_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"host string, digest string, {MEASURES}, line_keys array<long>, line_words array<long>"


def line_key(line: bytes) -> int:
    """Signed 64 bits; 0 for a line without a word."""
    normal = b" ".join(line.lower().translate(_DIGITS).split())
    return (xxhash.xxh3_64_intdigest(normal) or 1) - (1 << 63) if normal else 0


def repeated_words(words) -> np.ndarray:
    """For each word whether it lies in a window of REPEAT_WINDOW words that its text has twice or more."""
    n = len(words.hashes)
    at, keys = windows_of(words.hashes, words.first, REPEAT_WINDOW)
    keys ^= mix(words.text_of().astype(np.uint64)[at] + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return covered(n, at[twice], REPEAT_WINDOW)


def measure(texts: list[bytes]) -> tuple[list[np.ndarray], list[list[int]], list[list[int]]]:
    """The measures (in the order of MEASURES), and for each text its distinct line keys and the words under each."""
    words = words_of(texts)
    raw = np.frombuffer(words.data, np.uint8)

    def by_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])

    letters = ~IS_SPACE[raw] & ((raw & 0xC0) != 0x80)
    keys_of, words_under, dup_lines = [], [], []
    for text in texts:
        under: dict[int, int] = {}
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
        for line in lines:
            k = line_key(line)
            under[k] = under.get(k, 0) + len(line.split())
        keys_of.append(list(under))
        words_under.append(list(under.values()))
    columns = [np.diff(words.first), by_text(letters, words.begins), by_text(_SYMBOL[raw], words.begins), np.array(dup_lines, np.int64), by_text(repeated_words(words), words.first)]
    return columns, keys_of, words_under


def host_and_digest(host: Column, text: Column) -> list[Column]:
    return [F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.md5(F.coalesce(text, F.lit(""))).alias("digest")]


def verdicts(docs: DataFrame, host_col: str = "source", text_col: str = "text", limit_texts: int = LIMIT_TEXTS, limit_share: float = LIMIT_SHARE, scratch: Scratch | None = None) -> DataFrame:
    """One row for each distinct (host, digest of a text): the measures, base_failed, n_limited_words (words in lines above
    the limits), limited (those lines' keys) and kept.

    Equal texts of a host count once, so copies neither raise a line's frequency nor meet in one task. A null text counts
    as empty, a null host as the empty host. Texts of any length are taken whole; one text's words must fit into a worker
    (some 60 bytes for each of its bytes). Other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in as_bytes(batch.column(2))]
            for lo, hi in slices(texts):
                columns, keys, under = measure(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], *(pa.array(c.astype(np.int64)) for c in columns), pa.array(keys, pa.list_(pa.int64())), pa.array(under, pa.list_(pa.int64()))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    text = docs[text_col].cast("string")
    measured = docs.select(*host_and_digest(docs[host_col], text), text.alias("text")).mapInArrow(trimmed(run), SCHEMA)
    distinct = (scratch or Scratch(docs.sparkSession)).stored(measured.dropDuplicates(["host", "digest"]), "measures")
    lines = distinct.select("host", F.explode("line_keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > limit_texts)
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_texts"))
    above = lines.join(hosts, "host").where(F.col("texts") > limit_share * F.col("host_texts")).select("host", "key")
    pairs = distinct.select("host", "digest", F.explode(F.arrays_zip(F.col("line_keys").alias("key"), F.col("line_words").alias("words"))).alias("line")).select("host", "digest", "line.key", "line.words")
    limited = pairs.join(above, ["host", "key"]).groupBy("host", "digest").agg(F.sum("words").alias("n_limited_words"), F.collect_set("key").alias("limited"))
    out = distinct.drop("line_keys", "line_words").join(limited, ["host", "digest"], "left").withColumn("n_limited_words", F.coalesce("n_limited_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_limited_words")
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words")))


def judged(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """doc_id and its verdict's columns, for each row of docs. Repeated rows are judged alike; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.stored(verdicts(docs, host_col, text_col, scratch=scratch, **limits).drop("limited"), "verdicts")
    scratch.drop(found)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), *host_and_digest(docs[host_col], docs[text_col].cast("string")))
    return rows.join(found, ["host", "digest"])


def without_limited(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The kept rows of docs with their own columns, whatever their names, the lines above the limits taken out of the texts. Texts without such
    lines stay as they are, byte for byte."""
    names, n, scratch = docs.columns, docs.columns.index(text_col), Scratch(docs.sparkSession)
    found = scratch.stored(verdicts(docs, host_col, text_col, scratch=scratch, **limits).where("kept").select("host", "digest", "limited"), "kept")
    scratch.drop(found)
    host, digest = host_and_digest(docs[host_col], docs[text_col].cast("string"))
    rows = docs.select(*(docs[c].alias(f"c{k}") for k, c in enumerate(names)), host, digest).join(found, ["host", "digest"]).select(*(f"c{k}" for k in range(len(names))), "limited")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(n))
            for i, keys in enumerate(batch.column(len(names)).to_pylist()):
                if keys:
                    gone = set(keys)
                    texts[i] = b"\n".join(x for x in texts[i].split(b"\n") if line_key(x) not in gone)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()) if k == n else c for k, c in enumerate(batch.columns[:-1])], names=names)

    return rows.mapInArrow(trimmed(run), T.StructType([T.StructField(f.name, T.StringType() if k == n else f.dataType) for k, f in enumerate(docs.schema.fields)]))
